"""Document analytics on PySpark: typed tables out of documents, and questions over them as DataFrames."""

__version__ = "0.1.0"
