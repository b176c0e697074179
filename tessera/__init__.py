"""tessera: a PySpark-native raster analytics engine."""
