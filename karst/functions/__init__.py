"""Column expressions of the guard algebra."""
