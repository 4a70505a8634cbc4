"""postlake: a PySpark-native engine for incremental posting data."""
