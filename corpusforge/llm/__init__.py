"""Training-data operators: one module per operator, queries in ``llm.queries``.

Nothing else in the library imports this subpackage.
"""
