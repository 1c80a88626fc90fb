"""Document ETL, metadata validation and retrieval analytics on PySpark."""

__version__ = "0.1.0"
