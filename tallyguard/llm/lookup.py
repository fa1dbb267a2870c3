"""Worker-side tables of words already met, and ranges laid out one after the other."""

from __future__ import annotations

import numpy as np

_OWNED: dict[str, list[dict]] = {}


def claim(owner: str, *tables: dict) -> None:
    """Keeps ``tables`` for ``owner`` and empties those of other owners.

    Python workers outlive the jobs of one operator; without this a worker would hold the
    tables of every operator it has served.
    """
    for other, held in _OWNED.items():
        if other != owner:
            for table in held:
                table.clear()
    _OWNED[owner] = list(tables)


class Slots(dict):
    """Numbers words in order of appearance; ``taken`` gives those that are new since last time."""

    def __init__(self):
        super().__init__()
        self._new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = slot = len(self)
        self._new.append(word)
        return slot

    def taken(self) -> list[str]:
        new, self._new = self._new, []
        return new


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, length), one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
