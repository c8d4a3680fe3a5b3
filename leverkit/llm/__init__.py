"""Operators of a training-data pipeline; nothing else imports this package.

``queries.QUERIES`` and ``queries.ORACLE`` are registered by the entry module
when this package is present.
"""
