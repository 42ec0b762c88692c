"""Relational operators over versioned rows."""
