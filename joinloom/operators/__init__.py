"""Operators on DataFrames: verification and printing; scans, joins and projections are nodes of ``plans``."""
