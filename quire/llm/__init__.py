"""Operators for preparing language-model training data.

Nothing else in the library imports this package. ``quire.llm.entry`` has the
queries and the SQL that ``__spark_entry__`` adds when the package is present.
"""
