"""Jobs composed of operators: the batch build and the repair pass."""
