"""Column functions: pure expressions over built-in Spark SQL functions."""
