"""Operators for preparing training text at scale.

Nothing else in the package imports this one.  Each module holds one operator
with a general interface; ``queries`` binds them to the tables of a data folder.
"""
