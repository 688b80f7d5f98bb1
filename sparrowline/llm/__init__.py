"""Operators for preparing training text: one module per operator.

``mixing``, ``bpe``, ``quality``, ``html``, ``suffixes``, ``lines``, ``topk``,
``passages``, ``shingles`` and ``urls`` hold the operators; ``queries`` applies
each to a whole table. Nothing outside this package imports it.
"""
