"""Column expressions: text, dates, amounts and identities."""
