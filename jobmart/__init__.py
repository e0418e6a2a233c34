"""Job-market analytics as Spark DataFrame plans."""
