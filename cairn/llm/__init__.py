"""Operators that a training-data pipeline needs, as Spark jobs.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where it can be imported.
"""
