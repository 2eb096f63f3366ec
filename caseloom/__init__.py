"""A Spark-native engine for building, auditing and scoring typed decision datasets."""
