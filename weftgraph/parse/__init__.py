"""Parse of the code-graph engine."""
