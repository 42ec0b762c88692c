"""Compaction policies, their execution, and the query catalogue."""
