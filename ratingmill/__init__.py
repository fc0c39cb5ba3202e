"""PySpark-native engine for conversation, rating and training-data pipelines."""
