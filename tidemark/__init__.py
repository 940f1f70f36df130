"""Career-page analytics on PySpark."""
