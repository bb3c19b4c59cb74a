"""Sievework: repository, dependency and text policy checks as Spark queries."""

__version__ = "0.1.0"
