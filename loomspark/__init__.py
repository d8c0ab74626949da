"""A Spark-native engine for language-model training and evaluation data."""
