"""Vellum: governance rules, markup parsing and link-graph analysis over document corpora, on Spark."""

__version__ = "0.1.0"
