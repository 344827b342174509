"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` registers its
operators with the driver entry when the subpackage is present.
"""
