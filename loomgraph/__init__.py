"""A PySpark-native engine for knowledge graphs of software systems."""
