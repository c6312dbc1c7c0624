"""DataFrame operators: cleaning, dimensions, fact, quality checks, analytics."""
