"""Per-worker tables from a string to what a tokenizer makes of it.

A tokenizer is only asked about strings that a worker has not met lately; all
other work on a slice is Arrow and numpy over numbered strings.  Tables are
bounded: when one is full it starts anew, which costs time but never changes
a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Strings in each of the two generations that a worker remembers, and the
#: longest string that is remembered.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 64


class Remembered:
    """``get(strings)``: ``encode`` of each, through bounded dictionaries.

    There are two generations: when the younger is full it becomes the older
    one, and what is asked for again moves up, so frequent strings stay.
    """

    def __init__(self, encode: Callable[[list[str]], list], first: dict | None = None):
        self.encode, self.first, self.young, self.old = encode, first or {}, {}, {}

    def get(self, strings: list[str]) -> list:
        first, young, old = self.first.get, self.young, self.old
        out, miss = [None] * len(strings), []
        for i, s in enumerate(strings):
            x = first(s)
            if x is None:
                x = young.get(s)
                if x is None:
                    x = old.get(s)
                    if x is None:
                        miss.append(i)
                        continue
                    young[s] = x
            out[i] = x
        if miss:
            for i, x in zip(miss, self.encode([strings[i] for i in miss]), strict=True):
                out[i] = x
                if len(strings[i]) <= CACHE_CHARS:
                    young[strings[i]] = x
                    if len(young) >= CACHE_ENTRIES:
                        self.old, self.young = young, {}
                        young = self.young
        if len(young) >= CACHE_ENTRIES:
            self.old, self.young = young, {}
        return out


_WORKER: dict = {}


def in_worker(key: tuple, make: Callable[[], object]):
    """One object a Python worker process, kept across tasks.  A worker keeps
    the objects of one operator at a time (what stands before a dash in the
    key's name), and of each name the last, so a chain of operators does not
    pile up tables."""
    if key not in _WORKER:
        name = key[0]
        for old in list(_WORKER):
            if old[0] == name or old[0].split("-")[0] != name.split("-")[0]:
                del _WORKER[old]
        _WORKER[key] = make()
    return _WORKER[key]


def ragged(index: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[starts[i]:starts[i]+lengths[i]]`` for i in index."""
    n = lengths[index]
    total = int(n.sum())
    if not total:
        return flat[:0]
    begin = np.cumsum(n) - n
    at = np.arange(total, dtype=np.int64) + np.repeat(starts[index] - begin, n)
    return flat[at]
