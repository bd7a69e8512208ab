"""Spark-native preparation and evaluation of language-model data."""
