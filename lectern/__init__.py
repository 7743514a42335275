"""Lectern: a Spark-native engine for question-bank style document data."""
