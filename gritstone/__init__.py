"""A Spark-native engine for examining collections of files, text and log events."""
