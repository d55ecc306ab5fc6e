"""Operators for the preparation of training text, and their registered queries."""
