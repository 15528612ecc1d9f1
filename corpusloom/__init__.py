"""Spark-native operators for language-model corpora and small-model analytics."""
