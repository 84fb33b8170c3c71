"""Column expressions and ordered-scan building blocks."""
