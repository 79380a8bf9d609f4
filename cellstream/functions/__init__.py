"""Cells, expressions and predicates that compile to columns."""
