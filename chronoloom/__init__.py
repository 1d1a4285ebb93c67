"""chronoloom: a PySpark-native engine for time-series analytics."""
