"""tessera: a PySpark-native engine for interval, matrix, contingency and document analytics."""
