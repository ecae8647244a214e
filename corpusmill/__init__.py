"""Spark-native engine that ingests, indexes, searches and prepares text corpora."""
