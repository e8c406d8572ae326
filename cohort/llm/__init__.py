"""Operators of a training-data pipeline over raw text (documents, pages).

Nothing else in the library imports this package; the driver entry adds its
queries only when it can be imported.
"""
