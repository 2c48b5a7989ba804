"""Speech-corpus analytics on PySpark."""
