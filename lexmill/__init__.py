"""lexmill: a Spark-native engine for document analytics, retrieval and case search."""
