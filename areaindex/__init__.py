"""Small-area indicators as Spark DataFrame plans."""
