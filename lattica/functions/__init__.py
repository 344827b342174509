"""Column functions with the semantics of graph literals and Python strings."""
