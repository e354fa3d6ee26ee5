"""Registered queries, grouped by family, each with its reference SQL where SQL can say it."""
