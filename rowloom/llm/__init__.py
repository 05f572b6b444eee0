"""Operators for the preparation of training text.

Each module holds one operator with a general interface; `queries` holds the thin
queries that apply them to the standard tables. Nothing outside this folder imports it.
"""
