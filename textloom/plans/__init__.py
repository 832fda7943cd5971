"""Queries over the logical tables, each with the SQL that says the same."""
