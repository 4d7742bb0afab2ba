"""lodestone: a Spark-native engine for indexing and searching code and document corpora."""

__version__ = "0.1.0"
