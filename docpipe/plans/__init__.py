"""Pipelines: parsing, validation, compilation to DataFrames, and advice."""
