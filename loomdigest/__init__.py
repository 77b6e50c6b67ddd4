"""A PySpark-native engine that compacts long agent transcripts."""
