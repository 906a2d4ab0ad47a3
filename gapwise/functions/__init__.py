"""Column expressions over text and scores."""
