"""Operators of a training-data pipeline: search, de-duplication, classifiers, archives, packing.

Each module holds one operator with its own interface. `queries` registers them over whole tables, `sql` holds the SQL of
those that DuckDB can express. Nothing else in the library imports this package.
"""
