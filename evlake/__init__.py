"""Evidence tables on Spark: search, byte ranges, symbol resolution, integrity and ingestion.

Every operator takes DataFrames and column names and returns a DataFrame. The same code serves the
evidence tables of ``evlake.schema`` and any other keyed table.
"""
