"""gridloom: Spark-native operators for keyed panels and item tables."""

__version__ = "0.1.0"
