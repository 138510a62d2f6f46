"""A Spark-native engine for project memory, session logs and code graphs."""
