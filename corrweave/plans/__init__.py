"""Whole plans: panels made from the standard tables, the operators' queries over them, and SQL that says the same."""
