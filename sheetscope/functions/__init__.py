"""Column expressions: names, logical types and number cleaning."""
