"""Operators for preparing training text: scans, tokenisation, near copies, language, quality.

Nothing else in the library imports this subpackage.
"""
