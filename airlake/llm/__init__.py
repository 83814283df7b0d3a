"""Training-data operators over the ``documents`` and ``embeddings`` tables.

Nothing outside this subpackage imports it. Every operator selects the columns
it needs before it adds its own, so further columns of the input, whatever
their names, never clash with working columns.
"""
