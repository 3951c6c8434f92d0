"""Relational operators over measured records."""
