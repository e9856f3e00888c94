"""Training-data operators: one module per operator, all plain functions on DataFrames.

Nothing else in the library imports this subpackage.
"""
