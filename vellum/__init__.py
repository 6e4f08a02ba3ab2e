"""Vellum: document analytics and hybrid retrieval expressed as Spark plans."""

__version__ = "0.1.0"
