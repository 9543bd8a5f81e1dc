"""Operators for training-data pipelines, their registered queries and the SQL beside them.

Nothing outside this folder imports it. Each operator module states its method, its parameters and
what it does with nulls, empty texts, ties, repeated rows, empty tables and extra columns.
"""
