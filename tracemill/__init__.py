"""Spark-native curation and evaluation of annotated speech and reasoning data."""
