"""A PySpark-native engine that turns captured web pages into clean, retrieval-ready text."""
