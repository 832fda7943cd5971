"""Column expressions: text, versions, bits."""
