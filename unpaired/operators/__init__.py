"""Operators on graphs and pairs, each a composition of DataFrame operations."""
