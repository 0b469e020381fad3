"""Data onboarding and data quality on Spark."""

from sheetloom.dictionary import ENGLISH, LOGISTICS, Dictionary, StdField

__all__ = ["Dictionary", "StdField", "LOGISTICS", "ENGLISH"]
