"""Column functions: text, dates, scores and rules."""
