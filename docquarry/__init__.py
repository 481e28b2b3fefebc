"""docquarry: documents, vectors, pages and a property graph as Spark DataFrames."""

__version__ = "0.1.0"
