"""Spark-native analytics of scanned clinical documents."""
