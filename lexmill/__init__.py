"""lexmill: a PySpark-native engine for deterministic retrieval and text analytics."""
