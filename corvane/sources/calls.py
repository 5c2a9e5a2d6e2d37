"""Model calls of many rows at a time from one task: bounded concurrency, answers in the order of the rows."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from corvane.sources.generate import Client

ANSWERS = "answers array<struct<texts:array<string>,err:string>>"


def attempted(ask: Client, call: dict, attempts: int, wait: float):
    """The answers to one call, or its last error. Waits twice as long before each further attempt."""
    got = None
    for k in range(attempts):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        try:
            got = ask([call])[0]
        except Exception as e:
            got = e
        if not isinstance(got, Exception):
            break
    return got


def in_order(rows: Iterator[tuple], ask: Client, workers: int, attempts: int, wait: float) -> Iterator[tuple]:
    """(row, calls) -> (row, answers or errors of its calls), in order. At most 2 * workers calls wait or run beyond those
    of one row, however slow a call is: reading on stops until the oldest row is whole."""
    with ThreadPoolExecutor(workers) as threads:
        held: deque = deque()
        open_calls = 0
        for row, calls in rows:
            held.append((row, [threads.submit(attempted, ask, c, attempts, wait) for c in calls]))
            open_calls += len(calls)
            while held and open_calls > 2 * workers:
                row, futures = held.popleft()
                open_calls -= len(futures)
                yield row, [f.result() for f in futures]
        while held:
            row, futures = held.popleft()
            yield row, [f.result() for f in futures]


def answered(rows: DataFrame, factory: Callable[[], Client], workers: int = 8, attempts: int = 4, wait: float = 1.0, fail_fast: bool = False, out_rows: int = 256) -> DataFrame:
    """rows with a column `requests` (array of structs, a call each) -> the same rows in the same order and partitions with
    `answers`, one for each request: its texts, or the error of its last attempt (200 letters). A null or empty array
    asks nothing. fail_fast: an error ends the run. The client of a partition is called from several threads, one call
    at a time in each. A null text is ''. An executor that is lost costs the calls of its running tasks; what has been
    written (`sources/pool_log.py`) is not asked again."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()

        def each() -> Iterator[tuple]:
            for f in frames:
                for row in f.itertuples(index=False, name=None):
                    asked = row[names.index("requests")]
                    yield row, [dict(c) for c in (asked if asked is not None else ())]

        out = []
        for row, got in in_order(each(), ask, workers, attempts, wait):
            cells = []
            for g in got:
                if isinstance(g, Exception):
                    if fail_fast:
                        raise g
                    cells.append({"texts": [], "err": str(g)[:200] or type(g).__name__})
                else:
                    cells.append({"texts": [t or "" for t in g], "err": None})
            out.append((*row, cells))
            if len(out) == out_rows:
                yield pd.DataFrame(out, columns=[*names, "answers"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[*names, "answers"])

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *StructType.fromDDL(ANSWERS).fields]))
