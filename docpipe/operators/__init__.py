"""Predicates, projections and the other steps of a pipeline, as DataFrame transformations."""
