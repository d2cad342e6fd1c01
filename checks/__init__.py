"""Inputs derived from the given tables, the registered queries, and the SQL they are compared with."""
