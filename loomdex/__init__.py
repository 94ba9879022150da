"""A Spark-native engine for document search, knowledge bases and text pipelines."""
