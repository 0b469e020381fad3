"""Queries over the given tables with an equivalent SQL text for each."""

from checks import match, profile, relations, shape, texts, validate

MODULES = (shape, profile, match, validate, relations, texts)
