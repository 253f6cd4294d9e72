"""Operators of a training-data pipeline (quality, duplicates, leaks, mixing).

Each module holds one operator with a general interface; ``queries`` derives
the registered ``opN_`` results from them.  Nothing outside this subpackage
imports it.
"""
