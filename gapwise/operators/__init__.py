"""DataFrame operators, grouped by the table they start from."""
