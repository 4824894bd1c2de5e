"""Training-data operators: sharding, scoring, filtering, deduplication and encoding of whole corpora.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame,
selects the columns it reads by name (so further columns, whatever they are called, do no
harm) and returns a DataFrame; Spark partitions and shuffles all work, and Python code
inside tasks sees bounded slices of Arrow batches.
"""
