"""Column expressions and pixel helpers."""
