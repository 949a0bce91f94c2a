"""Training-data pipeline operators (text, tokens, embeddings) on Spark."""
