"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a function of
DataFrames: Spark partitions and shuffles the rows, and numpy works on whole
Arrow batches inside the tasks.
"""
