"""Operators for large-scale training-data pipelines.

Nothing else in ``taxolink`` imports this subpackage.  Each module holds one operator with a general
interface, the registered ``opN_*`` query that applies it to its whole table and, where SQL can express
the result, the DuckDB text.
"""
