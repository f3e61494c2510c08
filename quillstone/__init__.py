"""A PySpark-native analytics engine for knowledge bases."""
