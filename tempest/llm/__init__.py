"""Training-data operators: deduplication, scoring, mixing, sharding, tokens.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries
when it is present. Operators take and return DataFrames, read only the columns they name
(so extra columns never clash) and keep intermediate tables under ``spark.checkpoint.dir``.
"""
