"""Column expressions and the small numeric helper used by the fitting job."""
