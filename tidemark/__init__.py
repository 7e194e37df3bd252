"""Spark-native change, exposure and accessibility analytics."""
