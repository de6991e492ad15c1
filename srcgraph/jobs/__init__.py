"""Operators applied to the standard tables, with their SQL counterparts."""
