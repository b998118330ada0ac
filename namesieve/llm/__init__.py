"""Operators for preparing language-model training data.

Nothing else in the library imports this package. Each module holds one operator; ``catalog`` holds the
registered queries over the given tables and, where SQL can say the same, the SQL they are checked with.
"""
