"""seasonstar: monthly regional star schemas and seasonality analytics on PySpark."""
