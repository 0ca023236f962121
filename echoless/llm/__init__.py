"""Operators for preparing training text: thirteen methods and their queries."""
