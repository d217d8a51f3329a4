"""Operators for preparing language-model training data. Nothing else in docpipe imports this package."""
