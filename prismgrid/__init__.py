"""Spark-native filtering of gridded multi-channel data."""
