"""Operators for large text corpora: one module per operator, their named queries in ``queries``."""
