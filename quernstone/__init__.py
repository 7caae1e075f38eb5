"""quernstone: an analytics engine expressed in Spark DataFrames and SQL."""

__version__ = "0.1.0"
