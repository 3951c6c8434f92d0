"""Column functions: levels, units, tolerances, text and geometry."""
