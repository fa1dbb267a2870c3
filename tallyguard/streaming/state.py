"""Keyed state processors of single entries: anchored rate windows, time-limited risk deltas.

Each processor sorts the rows of its key in a micro-batch by (us, seq), so the results
equal the batch operators when micro-batches arrive in time order. With an event time, an entry that no row to come can still use is removed when the
watermark has passed it; without one it stays until the key is seen again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from tallyguard.schema import MICROS


def counts_since(times: np.ndarray, start: int, window: int) -> np.ndarray:
    """Rows within ``window`` before each row from ``start`` on, earlier ties included."""
    index = np.arange(start, len(times))
    return index - np.searchsorted(times, times[start:] - window, "left")


class _Expiring(StatefulProcessor):
    """One entry per key with an event-time timer at its end or before.

    Rows are taken and given as plain rows: most keys have few of them in a micro-batch, and a
    frame per key costs more than its rows. A newer entry leaves the timer; it is set anew when
    it fires.
    """

    entry = ""
    order: list[str] = []
    given: list[str] = []  # columns of the rows that come out

    def __init__(self, columns: list[str], timed: bool) -> None:
        """``columns`` are those of the rows that come in."""
        self._timed = timed
        self._at = {c: i for i, c in enumerate(columns)}

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getValueState("entry", self.entry)
        self._row = Row(*self.given)

    def until(self, entry: tuple) -> int:
        """The last second at which the entry can still be told from none."""
        raise NotImplementedError

    def answer(self, rows: list[tuple], entry: tuple | None) -> tuple[list[tuple], tuple | None]:
        """(values of the rows that come out, entry after them) for rows in order."""
        raise NotImplementedError

    def _sorted(self, rows: Iterator[Row]) -> list[tuple]:
        places = [self._at[c] for c in self.order]
        return sorted(map(tuple, rows), key=lambda r: [(r[i] is None, r[i] or 0) for i in places])

    def _keep(self, before: tuple | None, entry: tuple | None) -> None:
        """Stores the entry, to be removed when the watermark has passed its end."""
        if entry == before:
            return
        if entry is None:
            self._state.clear()
            return
        self._state.update(entry)
        if self._timed and before is None:
            self._handle.registerTimer(self.until(entry) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self._state.get()
        before = None if found is None else tuple(found)
        answers, entry = self.answer(self._sorted(rows), before)
        self._keep(before, entry)
        for values in answers:
            yield self._row(*values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self._state.get()
        if entry is not None:
            end = self.until(tuple(entry)) * 1000
            if end > timerValues.getCurrentWatermarkInMs():
                self._handle.registerTimer(end)
            else:
                self._state.clear()
        return iter([])

    def close(self) -> None:
        pass


def anchored_window(
    seconds: np.ndarray, used: int, start: int, most: int, window: int
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(allowed, wait, used, start) for requests in time order; one step per window, not per request.

    A window starts at the first request that finds the one before over, and lets its first
    ``most`` requests through.
    """
    allowed, wait, at = np.zeros(len(seconds), bool), np.zeros(len(seconds), np.int64), 0
    while at < len(seconds):
        if seconds[at] - start >= window:
            used, start = 0, int(seconds[at])
        end = int(np.searchsorted(seconds, start + window, "left"))
        some = min(max(most - used, 0), end - at)
        allowed[at : at + some] = True
        wait[at + some : end] = np.maximum(0, window - (seconds[at + some : end] - start))
        used, at = used + some, end
    return allowed, wait, used, start


class RateWindow(_Expiring):
    """Anchored request window of a key: (requests used, window start)."""

    fields = "allowed boolean, retry_after_s bigint"
    entry = "used bigint, start bigint"
    order = ["us", "seq"]

    def __init__(self, columns: list[str], max_requests: int, window_s: int, timed: bool = False) -> None:
        super().__init__(columns, timed)
        self.given = [*columns, "allowed", "retry_after_s"]
        self._max, self._window = max_requests, window_s

    def until(self, entry: tuple) -> int:
        return entry[1] + self._window

    def answer(self, rows: list[tuple], entry: tuple | None) -> tuple[list[tuple], tuple | None]:
        us = self._at["us"]
        seconds = np.array([r[us] // MICROS for r in rows], np.int64)
        used, start = entry or (0, int(seconds[0]))
        allowed, wait, used, start = anchored_window(seconds, used, start, self._max, self._window)
        return [(*r, a, w) for r, a, w in zip(rows, allowed.tolist(), wait.tolist())], (used, start)


class RiskCache(_Expiring):
    """Risk delta of a key with a time limit; a late read removes the entry.

    A read within ``ttl_s`` seconds of the last write is a hit; the first one after that
    is expired and removes the entry. An entry that nobody reads is dropped ``ttl_s`` seconds
    after it has expired; reads later than that miss.
    """

    fields = "graph_delta double, graph_reason string, outcome string"
    entry = "delta double, reason string, at_s bigint"
    order = ["us", "kind", "seq"]

    def __init__(self, columns: list[str], kept: list[str], ttl_s: int, timed: bool = False) -> None:
        super().__init__(columns, timed)
        self.given = [*kept, "graph_delta", "graph_reason", "outcome"]
        self._kept = [self._at[c] for c in kept]
        self._ttl, self._most = ttl_s, 2 * ttl_s

    def until(self, entry: tuple) -> int:
        return entry[2] + self._most + 1

    def answer(self, rows: list[tuple], entry: tuple | None) -> tuple[list[tuple], tuple | None]:
        us, kind, delta, reason = (self._at[c] for c in ("us", "kind", "risk_delta", "reason"))
        answers = []
        for r in rows:
            second = r[us] // MICROS
            if r[kind] == 0:
                entry = (r[delta], r[reason], second)
                continue
            found = (0.0, "cold", "miss")
            if entry is not None:
                age = second - entry[2]
                if age <= self._ttl:
                    found = (entry[0], entry[1], "hit")
                else:
                    entry = None
                    if age <= self._most:
                        found = (0.0, "cold", "expired")
            answers.append((*[r[i] for i in self._kept], *found))
        return answers, entry
