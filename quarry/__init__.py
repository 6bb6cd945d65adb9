"""A PySpark-native engine for document analytics and hybrid retrieval."""
