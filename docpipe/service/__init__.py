"""Requests and responses as dictionaries: validation, users, permissions and errors."""
