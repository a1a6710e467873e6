"""Web-archive analytics on PySpark DataFrames."""
