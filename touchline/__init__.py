"""touchline: a PySpark-native engine for spatio-temporal sports tracking tables."""
