"""finlark: filing, market and training-data analytics as PySpark DataFrame plans."""
