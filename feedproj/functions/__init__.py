"""Column expressions: no joins, no shuffles, no actions."""
