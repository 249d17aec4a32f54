"""Training-data operators over documents, conversations, embeddings and pages.

Every operator takes DataFrames and column names. Where rows leave Spark's own functions they go
through Arrow batches in bounded blocks, so one very long text never multiplies in memory.
"""
