"""Spark-native analytics for live speech-translation sessions."""
