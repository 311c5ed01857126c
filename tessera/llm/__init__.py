"""Training-data operators: one module an operator, ``queries`` holds what the entry module registers.

Nothing outside this folder imports it, apart from ``corpus_pipeline`` at the repository's top.
"""
