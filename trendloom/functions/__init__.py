"""Column functions (no UDF unless stated): text, dates, predicates."""
