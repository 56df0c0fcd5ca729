"""Tessera: a PySpark-native engine for evidence-retrieval corpora and training data."""
