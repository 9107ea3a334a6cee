"""Positional plans, the SQL front end, join graphs, join orders and EXPLAIN-shaped plans."""
