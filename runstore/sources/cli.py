"""A prompt over a table: open, put, get, delete, scan, flush, compact, quit."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from ..operators.bounds import Bound
from .store import Options, Store

USAGE = {"open": "<path>", "put": "<key> <value>", "get": "<key>", "delete": "<key>", "scan": "<lower|*> <upper|*>", "flush": "", "compact": ""}


def answers(spark: SparkSession, lines: Iterable[str]) -> Iterator[str]:
    store: Store | None = None
    for line in lines:
        verb, *args = line.split() or [""]
        if not verb:
            continue
        if verb in ("quit", "exit"):
            break
        if verb not in USAGE:
            yield f"unknown command: {verb}"
        elif len(args) != len(USAGE[verb].split()):
            yield f"usage: {verb} {USAGE[verb]}".rstrip()
        elif verb == "open":
            if store:
                store.close()
            store = Store(spark, args[0], Options(wal=True))
            yield "OK"
        elif store is None:
            yield "no table is open"
        elif verb == "get":
            yield store.get(args[0]) or "(not found)"
        elif verb == "scan":
            lower, upper = Bound() if args[0] == "*" else Bound.included(args[0]), Bound() if args[1] == "*" else Bound.excluded(args[1])
            for r in store.scan(lower, upper).toLocalIterator():
                yield f"{r.key} {r.value}"
            yield "OK"
        else:
            {"put": store.put, "delete": store.delete, "flush": store.flush, "compact": store.force_full_compaction}[verb](*args)
            yield "OK"
    if store:
        store.close()


def main() -> None:
    spark = SparkSession.builder.appName("runstore").getOrCreate()
    for answer in answers(spark, sys.stdin):
        print(answer, flush=True)


if __name__ == "__main__":
    main()
