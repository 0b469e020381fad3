"""Whole tasks put together from the operators."""
