"""Spark-native retrieval, fusion and corpus-processing operators (DataFrame in, DataFrame out)."""
