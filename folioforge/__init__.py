"""A Spark-native engine for research-document catalogues."""
