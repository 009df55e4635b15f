"""Column expressions of the table model: missing markers, numbers, keys, dates and formats."""
