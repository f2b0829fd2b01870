"""tidewell: a PySpark-native analytics engine (see README.md)."""
