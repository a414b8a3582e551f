"""Relational operators on graphs, documents and vectors; each builds a DataFrame and runs nothing."""
