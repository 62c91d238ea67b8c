"""sluice: a PySpark-native streaming-lake analytics engine."""
