"""A PySpark-native engine for keyed, changing tables."""
