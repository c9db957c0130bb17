"""Operators of a training-data pipeline, one module each.

Nothing outside this package imports it. Every operator takes and returns
DataFrames; intermediate tables that later steps read more than once are
written below the folder that ``spark.checkpoint.dir`` names, so a lost
executor costs a re-read, not a recomputation.
"""
