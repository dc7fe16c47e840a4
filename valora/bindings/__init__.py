"""Queries over the given tables, one per operator, each with its check where SQL can say it."""
