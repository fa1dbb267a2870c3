"""Brute-force models of the window semantics, one row at a time."""

from __future__ import annotations

import math
import random


def tie_heavy_rows(n: int, seed: int, hot_share: float = 0.4) -> list[dict]:
    """Rows with many equal times; one sender and one receiver hold a large share."""
    rng = random.Random(seed)
    return [
        {
            "seq": i,
            "us": rng.randrange(0, 60) * 10,
            "snd": "hot" if rng.random() < hot_share else f"s{rng.randrange(5)}",
            "rcv": "hub" if rng.random() < hot_share else f"r{rng.randrange(3)}",
            "amount": round(rng.uniform(1, 500), 2),
        }
        for i in range(n)
    ]


def prior(rows, row, key, window, ties):
    """Earlier rows of the key inside the window."""
    out = []
    for other in rows:
        if other[key] != row[key] or other["us"] < row["us"] - window:
            continue
        if other["us"] < row["us"] or (
            ties == "row" and other["us"] == row["us"] and other["seq"] < row["seq"]
        ):
            out.append(other)
    return out


def moments(values):
    if not values:
        return 0, None, None
    mean = math.fsum(values) / len(values)
    return len(values), mean, math.fsum((v - mean) ** 2 for v in values)
