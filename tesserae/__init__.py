"""A PySpark-native engine for large geospatial feature sets."""
