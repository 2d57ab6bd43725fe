"""Operators for preparing training text: each module holds one operator.

Nothing outside this subpackage imports it.  ``queries.py`` wires the operators
to the contract tables.
"""
