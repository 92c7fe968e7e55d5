"""Veinwork: a PySpark-native analytics engine for talent data."""
