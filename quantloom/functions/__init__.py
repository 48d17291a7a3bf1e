"""Column functions with one rule for undefined values: NULL."""
