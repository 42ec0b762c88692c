"""Streams of mutations into versioned tables."""
