"""Column functions: text, arrays, values and arithmetic."""
