"""Operators for preparing training text: thirteen DataFrame jobs and the queries that apply them.

Nothing outside this subpackage imports it, and it can be removed as a whole.
"""
