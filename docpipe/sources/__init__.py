"""Collections on storage: change logs, the catalog of databases, and imports."""
