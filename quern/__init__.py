"""quern: a Spark-native corpus, token and evaluation engine."""

__version__ = "0.1.0"
