"""tidemark: set-based market and recommendation analytics on Spark DataFrames.

Sub-packages
------------
sources    driver tables and their bindings to the logical market tables
functions  column-expression helpers (dates, text, numeric, predicates)
operators  reusable DataFrame operators (as-of, merge/upsert, calendar, bars)
plans      the user-visible queries, one function each, over whole tables
streaming  file-stream upsert with watermark and idempotent foreachBatch
"""

__all__ = ["session"]
