"""Operators for preparing training text; nothing else in the library imports this subpackage.

Each module holds one operator with a general interface; ``queries.py`` holds the thin
``opN_<name>`` queries over the tables of a data directory.
"""
