"""Spark-native retrieval over versioned, clause-structured documents."""
