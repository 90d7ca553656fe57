"""Column helpers. Every function takes and returns native Spark columns."""
