"""Training-data operators: text preparation jobs for large corpora.

Nothing outside this subpackage imports it.
"""
