"""Operators over knowledge graphs and their results."""
