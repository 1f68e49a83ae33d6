"""Spark-native analytics for frame-level multimodal retrieval."""
