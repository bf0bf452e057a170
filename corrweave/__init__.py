"""Rolling-graph risk analytics on PySpark."""
