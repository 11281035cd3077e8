"""A PySpark-native analytics engine for ball-by-ball sports data."""
