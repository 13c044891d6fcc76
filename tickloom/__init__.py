"""tickloom: a Spark-native engine for bar-panel research and corpus preparation."""
