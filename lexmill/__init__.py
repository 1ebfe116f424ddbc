"""A Spark-native engine that indexes documents and answers queries over them."""
