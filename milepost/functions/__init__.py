"""Column expressions, label codes, size-checked broadcasts and bounded-memory exact medians."""
