"""linkloom: a Spark-native engine that turns saved links and their texts into a knowledge base."""
