"""Column expressions: geodesy, sun, water levels, text and time."""
