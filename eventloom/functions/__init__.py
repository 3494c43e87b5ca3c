"""Column helpers: text rules, field addressing, JSON text, predicates."""
