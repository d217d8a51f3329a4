"""Live queries over change logs."""
