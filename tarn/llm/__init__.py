"""Training-data operators: one module per operator, queries and SQL in ``catalogue``.

Nothing outside this subpackage imports it.
"""
