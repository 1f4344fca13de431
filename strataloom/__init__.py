"""strataloom: Spark-native analytics over content-addressed releases of files."""
