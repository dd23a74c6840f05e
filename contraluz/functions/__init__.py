"""Column expressions: text, dates, money and charset repair."""
