"""Spark-native analytics for segmented 2D and 3D objects."""
