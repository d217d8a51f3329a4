"""Values, paths and scalar functions as Columns."""
