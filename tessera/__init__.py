"""A Spark-native engine for document intelligence and hybrid retrieval.

Every operator maps DataFrames to DataFrames over many documents, queries or
conversations at once; see README.md for the map of modules.
"""
