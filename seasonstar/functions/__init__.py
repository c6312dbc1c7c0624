"""Column expressions: text cleaning, calendar attributes, numeric helpers."""
