"""lotwise: a Spark-native engine for messy multi-source listing data."""
