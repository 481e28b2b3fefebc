"""Operators for preparing language-model training data.

Nothing else in docquarry imports this subpackage; it can be removed as a whole.
"""
