"""Spark-native analytics for georeferenced grids and survey lines."""
