"""lattica: knowledge-graph analytics on PySpark."""
