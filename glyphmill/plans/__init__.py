"""Whole dataset jobs built from the operators."""
