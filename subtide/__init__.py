"""Caption analytics on PySpark: every operator is a lazy DataFrame transform."""

__version__ = "0.1.0"
