"""Column functions that predicates and facades are made of."""
