"""Questionnaire analytics as keyed Spark DataFrame transformations."""

__version__ = "0.1.0"
