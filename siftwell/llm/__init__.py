"""Operators for building language-model training data.

Nothing outside this subpackage imports it.  ``queries`` lists the queries,
one per operator, and the SQL where SQL can express the result.
"""
