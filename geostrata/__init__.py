"""geostrata: a PySpark-native engine for collections of geographic features."""
