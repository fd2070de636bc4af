"""A Spark-native engine for building, cleaning, measuring and packing text corpora."""
