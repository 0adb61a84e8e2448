"""Relational operators over genealogy tables; DataFrames in, DataFrames out."""
