"""Schema migrations of a versioned store: ordered steps, up and down, each one commit.

A step rewrites the tables that it names, all of them in one version, together with the
number of the schema, so a step is there whole or not at all, and a step that was done is
not done again.  Readers at earlier versions still see the earlier schema.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from quillon.operators import versions

Change = Callable[[DataFrame], DataFrame]


class Step(NamedTuple):
    number: int  # of the schema that up leads to
    up: dict[str, Change]
    down: dict[str, Change]


def schema(spark: SparkSession, root: str) -> int:
    """Number of the store's schema; 0 before any step."""
    return versions.manifest(spark, root).get("schema", 0)


def migrate(spark: SparkSession, root: str, steps: list[Step], to: int) -> list[int]:
    """Takes the store to the schema number to by the steps in between; returns the numbers that were passed."""
    known = {s.number: s for s in steps}
    now = schema(spark, root)
    levels = sorted({0, *known} | {now})
    if to not in levels or (now and now not in known):
        raise ValueError(f"no steps lead from schema {now} to {to}")
    way = [n for n in levels if min(now, to) <= n <= max(now, to)]
    way = way if to >= now else way[::-1]
    for before, after in zip(way[:-1], way[1:], strict=True):
        _step(spark, root, known[after].up if to > now else known[before].down, before, after)
    return way[1:]


def _step(spark: SparkSession, root: str, changes: dict[str, Change], before: int, after: int) -> None:
    at = versions.version(spark, root)
    segments = [versions.write(f(versions.read(spark, root, table, at)), root, table) for table, f in changes.items()]

    def make(m: dict, n: int) -> dict:
        if n != at + 1 or m.get("schema", 0) != before:
            raise versions.Conflict("the store changed while its schema did")
        for s in segments:
            m["schemas"][s["table"]], m["tables"][s["table"]] = s["schema"], [{"name": s["name"], "seq": n}]
        return m | {"schema": after}

    versions.change(spark, root, make)
