"""Spark-native analytics for noisy media-stream catalogues."""
