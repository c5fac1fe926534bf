"""Column expressions: no joins, no shuffles, code-generated by Spark."""
