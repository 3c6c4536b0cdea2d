"""Operators for preparing training text and vectors on Spark.

Nothing outside this subpackage imports it.
"""
