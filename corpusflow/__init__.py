"""A Spark-native engine that prepares and measures text for language models."""
