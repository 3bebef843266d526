"""Queries over the driver's tables, each with the SQL that gives the same rows."""
