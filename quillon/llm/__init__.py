"""Training-data operators: ten corpus-scale operators and their registered queries.

Nothing outside this package imports it; ``quillon.llm.queries`` registers the
``opN_<name>`` queries and their SQL.
"""
