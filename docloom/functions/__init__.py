"""Column functions: text, dates, vectors and decision tables."""
