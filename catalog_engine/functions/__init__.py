"""Column functions: normalisation, predicates, cost and score formulas."""
