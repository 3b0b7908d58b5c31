"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator; :mod:`packframe.llm.registry` holds their queries and SQL.
"""
