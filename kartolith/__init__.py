"""PySpark-native analytics over versioned map edits."""
