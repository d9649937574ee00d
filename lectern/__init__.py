"""Lectern: analytics over document corpora, written for Spark's DataFrame planner."""

__version__ = "0.1.0"
