"""Training-data operators: ten Spark jobs over documents, pages and embeddings.

Nothing else in ``voxloom`` imports this subpackage.
"""
