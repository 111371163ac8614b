"""Operators for large-scale training-data preparation.

Each module holds one operator; ``queries`` holds their registered queries.
Nothing outside this subpackage imports it.
"""
