"""Cohort and branching-structure analytics on Spark: tables in, tables out."""

__version__ = "0.1.0"
