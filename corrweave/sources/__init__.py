"""Reading raw exports and reports, and writing tidy tables, graphs, models and reports."""
