"""Spark-native detection, tokenization and audit of personal data, with the surrounding analytics."""
