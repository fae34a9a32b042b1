"""Revisions that arrive one after the other: the current version of every object, as a keyed stream.

Each (doc_id, obj) holds its newest version in the state store; a row leaves when a
later one replaces or frees it. Rows that arrive late and are older change nothing,
so what has left last for a key is what :func:`merged` gives over all rows. A key
that has idle for ``keep_ms`` is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERSION = "at long, gen int, value string, free boolean"
CURRENT = f"doc_id long, obj int, {VERSION}"
#: Later revisions hold; of one revision the higher generation, and what frees an object.
NEWEST = ("at", "gen", "free")


def current_versions(arriving: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Changes of the current version of each object of a stream of rows (doc_id, obj, at, gen, value, free).

    With ``keep_ms`` the query needs a trigger that goes on: one that stops when all is read would wait for the keys to expire.
    """

    def newest(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = best = state.get if state.exists else None
        for pdf in rows:
            for at, gen, value, free in zip(pdf["at"], pdf["gen"], pdf["value"], pdf["free"], strict=True):
                version = int(at), int(gen), None if value is None or pd.isna(value) else str(value), bool(free)
                if best is None or (version[0], version[1], version[3]) > (best[0], best[1], best[3]):
                    best = version
        state.update(best)
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        if best is not held:
            yield pd.DataFrame([(key[0], key[1], *best)], columns=["doc_id", "obj", "at", "gen", "value", "free"])

    keyed = arriving.select("doc_id", "obj", "at", "gen", "value", "free").groupBy("doc_id", "obj")
    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return keyed.applyInPandasWithState(newest, CURRENT, VERSION, "update", timeout)


def merged(rows: DataFrame) -> DataFrame:
    """The current version of each object over all rows at once; freed ones stay, marked."""
    newest = Window.partitionBy("doc_id", "obj").orderBy(*[F.desc(c) for c in NEWEST])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").select("doc_id", "obj", "at", "gen", "value", "free")
