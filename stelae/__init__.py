"""Spark-native analytics over annotated text corpora and the records around them."""
