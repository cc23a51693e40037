"""quellmark: Spark-native message-toxicity analytics and text-corpus preparation."""
