"""Whole imports, composed of operators."""
