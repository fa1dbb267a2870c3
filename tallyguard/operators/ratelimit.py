"""Anchored-window rate limiting per key.

A window opens at the first request after the previous one ended; the first
``max_requests`` in it pass, the rest are denied and do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.skew import match_on
from tallyguard.schema import MICROS


def _window_starts(window_s: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Add each second's window start and the requests before it in that window."""
        key, start, used = None, 0, 0
        for batch in batches:
            keys = batch["key"].to_numpy()
            sec = batch["sec"].to_numpy()
            n = batch["n"].to_numpy()
            total = np.concatenate(([0], np.cumsum(n)))
            starts = np.empty(len(batch), dtype=np.int64)
            before = np.empty(len(batch), dtype=np.int64)
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else []
            for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    key, start, used = keys[lo], int(sec[lo]), 0
                at = lo
                while at < hi:
                    if sec[at] - start >= window_s:
                        start, used = int(sec[at]), 0
                    end = at + int(np.searchsorted(sec[at:hi], start + window_s, "left"))
                    starts[at:end] = start
                    before[at:end] = used + total[at:end] - total[at]
                    used += int(total[end] - total[at])
                    at = end
            yield pd.DataFrame(
                {"key": keys, "sec": sec, "window_start": starts, "used_before": before}
            )

    return scan


def rate_limit(
    requests: DataFrame,
    key: str,
    max_requests: int,
    window_s: int,
    us: str = "us",
    seq: str = "seq",
) -> DataFrame:
    """Add ``allowed`` and ``retry_after_s`` to each request.

    Requests are first counted per (key, second), the clock's resolution. The
    scan then streams at most one row per second and key with constant state,
    whatever the number of requests, and ranks are taken within single seconds.
    """
    timed = requests.withColumn("_sec", F.expr(f"{us} div {MICROS}L"))
    seconds = (
        timed.groupBy(F.col(key).alias("key"), F.col("_sec").alias("sec"))
        .agg(F.count(F.lit(1)).alias("n"))
        .repartition("key")
        .sortWithinPartitions("key", "sec")
    )
    windows = seconds.mapInPandas(
        _window_starts(window_s),
        f"key {requests.schema[key].dataType.simpleString()}, sec bigint, "
        "window_start bigint, used_before bigint",
    ).select(F.col("key").alias(key), F.col("sec").alias("_sec"), "window_start", "used_before")
    rank = F.row_number().over(Window.partitionBy(key, "_sec").orderBy(us, seq))
    placed = match_on(timed.withColumn("_rank", rank), windows, [key, "_sec"], "inner", null_safe=True)
    allowed = F.col("used_before") + F.col("_rank") <= max_requests
    wait = F.greatest(F.lit(0), F.lit(window_s) - (F.col("_sec") - F.col("window_start")))
    return placed.select(
        *requests.columns,
        allowed.alias("allowed"),
        F.when(allowed, F.lit(0)).otherwise(wait).cast("bigint").alias("retry_after_s"),
    )
