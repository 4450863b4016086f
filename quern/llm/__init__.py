"""Operators for preparing language-model training data at cluster scale.

Nothing outside this package imports it.  Every module holds one operator with
a general interface; ``queries`` derives the registered queries from them.
"""
