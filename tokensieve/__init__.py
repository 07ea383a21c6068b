"""tokensieve: a Spark-native statistical message-classification engine."""
