"""Whole results put together from the operators."""
