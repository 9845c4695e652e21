"""Operators on layers, seed sets, embeddings and populations: DataFrames in, DataFrames out."""
