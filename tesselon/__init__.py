"""Spark-native analytics for very large tiled images and the tables derived from them."""
