"""Expressions: scalars, predicates, aggregates and the texts of time spans."""
