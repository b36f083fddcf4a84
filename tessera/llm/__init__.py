"""Corpus operators for training-data pipelines.

Each module holds one operator with its own general interface; ``queries``
binds them to the test tables. Nothing outside this subpackage imports it.
"""
