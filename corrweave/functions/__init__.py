"""Column expressions: cleaning of raw values, and arithmetic over arrays of a window's values."""
