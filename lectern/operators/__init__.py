"""Relational operators for curating, checking and scoring evaluation data."""
