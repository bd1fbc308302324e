"""tessera: Spark-native analytics over prompts, conversations and training documents."""
