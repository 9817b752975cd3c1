"""Incremental work: verdicts that arrive over time.

The data model has no event time, so there are no windows here.
"""
