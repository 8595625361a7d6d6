"""Column expressions: text, arrays and the fixed patterns they use."""
