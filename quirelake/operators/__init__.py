"""Relational operators over literature records."""
