"""A PySpark-native engine for architecture graphs, document retrieval, security findings and training corpora."""
