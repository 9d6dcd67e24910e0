"""millrace: a PySpark-native analytics library for log, event, relational and text data."""
