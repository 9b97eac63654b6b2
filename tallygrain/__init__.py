"""Spark-native product matching, price extraction and run analytics."""
