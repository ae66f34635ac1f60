"""Retrieval and memory analytics over large collections of text records: DataFrames in, DataFrames out."""
