"""Key ranges as predicates. Keys compare as unsigned bytes, Spark's default string order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    key: str | None = None
    inclusive: bool = True

    @staticmethod
    def unbounded() -> Bound:
        return Bound()

    @staticmethod
    def included(key: str) -> Bound:
        return Bound(key, True)

    @staticmethod
    def excluded(key: str) -> Bound:
        return Bound(key, False)


def in_range(lower: Bound = Bound(), upper: Bound = Bound(), key: str = "key") -> Column:
    """Rows within both bounds; inverted ranges hold nothing."""
    out = F.lit(True)
    if lower.key is not None:
        out = F.col(key) >= lower.key if lower.inclusive else F.col(key) > lower.key
    if upper.key is not None:
        above = F.col(key) <= upper.key if upper.inclusive else F.col(key) < upper.key
        out = above if lower.key is None else out & above
    return out


def may_hold(lower: Bound, upper: Bound, first: str, last: str) -> bool:
    """Whether a file of keys first..last can hold keys of the range."""
    if lower.key is not None and (last.encode() < lower.key.encode() or not lower.inclusive and last == lower.key):
        return False
    return not (upper.key is not None and (first.encode() > upper.key.encode() or not upper.inclusive and first == upper.key))
