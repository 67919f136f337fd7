"""netloom: a PySpark-native engine for network statistics and network models."""
