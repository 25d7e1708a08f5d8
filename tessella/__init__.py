"""Spark-native analytics for partitioned surfaces: rasters, region graphs, meshes, topology documents."""
