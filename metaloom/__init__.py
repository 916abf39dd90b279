"""PySpark-native metadata integration and analytics."""
