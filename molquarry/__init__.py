"""Spark-native curation, route analysis and evaluation analytics for molecule tables."""
