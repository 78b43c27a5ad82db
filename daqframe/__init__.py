"""Analytics of self-describing measurement logs on PySpark."""
