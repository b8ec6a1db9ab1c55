"""Relational operators of the verification engine."""
