"""Column builders: clocks, orderings, predicates, scalar functions, fixed values."""
