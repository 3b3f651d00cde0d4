"""Column functions: text, dates and sales arithmetic."""
