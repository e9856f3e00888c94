"""Operators: plain functions from DataFrames to DataFrames, lazily composed."""
