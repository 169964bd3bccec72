"""Column expressions: text, dates and article fields. No Python workers here."""
