"""Tessera: a PySpark-native engine for operational message and job-lifecycle analytics."""
