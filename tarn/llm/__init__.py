"""Operators for building language-model training corpora with Spark.

Nothing else in the package imports this subpackage.
"""
