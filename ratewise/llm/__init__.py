"""Training-data operators: each module holds one operator with its general interface.

Nothing outside this subpackage imports it; ``llm/queries.py`` registers the
thin ``opN_<name>`` queries and ``corpus_pipeline.py`` chains five operators.
"""
