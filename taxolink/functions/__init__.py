"""Column expressions; each takes and returns Columns, or renames columns without touching data."""
