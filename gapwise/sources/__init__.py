"""Reading event logs and reading, writing and exporting the stored tables."""
