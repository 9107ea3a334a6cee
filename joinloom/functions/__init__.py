"""Predicates as Spark columns."""
