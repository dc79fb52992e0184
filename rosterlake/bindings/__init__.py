"""Queries over the given tables: each binds an operator, with SQL for the same answer."""
