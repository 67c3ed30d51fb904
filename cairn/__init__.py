"""A Spark-native engine that keeps a searchable, incrementally refreshed index of a tree of text files."""
