"""PySpark-native analytics over ordered, positioned and tagged sample streams and packets."""
