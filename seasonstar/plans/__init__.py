"""End-to-end jobs: the warehouse build and the registered queries."""
