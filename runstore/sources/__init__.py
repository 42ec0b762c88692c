"""Versioned tables on disk."""
