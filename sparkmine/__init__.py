"""sparkmine: analytics and data mining as lazy PySpark DataFrame operators."""
