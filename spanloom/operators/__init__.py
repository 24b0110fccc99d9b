"""Operators over interval tables: DataFrames in, DataFrames out."""
