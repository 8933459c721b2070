"""Operators of a training-data pipeline over text, pages and conversations.

Nothing else in the library imports this subpackage.
"""
