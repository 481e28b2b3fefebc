"""Operators over DataFrames: vectors, pages, graph."""
