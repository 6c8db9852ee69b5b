"""Verdigris: a PySpark-native engine for content decisions."""
