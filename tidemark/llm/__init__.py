"""Training-data operators: ten independent modules and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
