"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; ``queries`` registers one query
for each operator and the oracle SQL where SQL can express it.
"""
