"""Operators for preparing training data: thirteen independent modules and their queries.

Nothing outside this folder imports it; remove it and the rest of the library is unaffected.
"""
