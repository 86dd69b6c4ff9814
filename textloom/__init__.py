"""textloom: a Spark-native engine for preparing, auditing, searching and scoring text corpora."""
