"""A Spark-native engine for traceable reading of disclosure documents."""
