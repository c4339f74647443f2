"""barloom: market-data analytics as DataFrame -> DataFrame functions on PySpark."""
