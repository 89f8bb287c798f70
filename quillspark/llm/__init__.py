"""Operators for preparing training data at cluster scale.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries and
their SQL twins; every other module is one operator with its own general interface.
"""
