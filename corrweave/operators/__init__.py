"""Relational operators: each takes and returns DataFrames, lazily, with plans left to Catalyst."""
