"""A PySpark-native graph, similarity and corpus analytics engine."""

__version__ = "0.1.0"
