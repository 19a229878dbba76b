"""Column functions: clocks, numbers, text and JSON."""
