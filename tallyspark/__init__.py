"""Spark-native accounting of inverted-index stores."""
