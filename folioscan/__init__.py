"""Spark-native analytics over documents and drawings held as relations."""
