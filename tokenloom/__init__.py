"""tokenloom: a PySpark-native engine for discrete token sequences."""

__version__ = "0.1.0"
