"""quarrystone: a PySpark-native analytics engine."""
