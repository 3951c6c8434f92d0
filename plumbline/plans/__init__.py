"""Domain tables projected from the test tables, and the registered queries."""
