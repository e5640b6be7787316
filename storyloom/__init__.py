"""A Spark-native engine for story corpora and the analytics of continual-learning experiments."""
