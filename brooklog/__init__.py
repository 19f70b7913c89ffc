"""brooklog: a Spark-native engine for stream-log, delivery and measurement analytics."""
