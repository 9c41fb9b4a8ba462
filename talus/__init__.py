"""talus: a PySpark-native record-intelligence engine."""
