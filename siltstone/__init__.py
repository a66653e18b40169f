"""siltstone: a Spark-native engine for corpus and time-series analytics."""
