"""Spark-native analytics over transcribed conversations."""
