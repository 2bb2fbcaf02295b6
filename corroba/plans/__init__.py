"""Registered queries over the tables, each with the same query in SQL where SQL can express it."""

from corroba.plans import flow, mapping, matching, names, queries, rules, sources

__all__ = ["flow", "mapping", "matching", "names", "queries", "rules", "sources"]
