"""Relational operators over chunks, claims, gold spans and results."""
