"""Operators for preparing training text, each a Spark job over whole tables.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
