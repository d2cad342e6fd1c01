"""Recompression: a run-length grammar of a sequence, and extensions of equal parts read off it.

Levels alternate between block compression (a run of one symbol becomes one symbol) and pair compression (the symbols are parted into
left and right ones, and every left one followed by a right one becomes one symbol with it). Both look at symbols
alone, so equal parts of the sequence are compressed alike but for their borders. An extension query climbs while the two
places agree, steps over the few symbols at the border of each level, and descends to the first difference: a constant number of symbols a
level, and the levels are the logarithm of the length. All queries of a call take each level together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from catloom.llm.common import mix


@dataclass
class Level:
    symbols: np.ndarray
    up: np.ndarray  # the symbol above that holds a place
    first: np.ndarray  # where each symbol above begins; one more at the end
    right: np.ndarray | None  # for pairs: whether a place has a right symbol; None for blocks


def _named(keys: np.ndarray) -> np.ndarray:
    return pd.factorize(keys)[0]


def _blocks(symbols: np.ndarray) -> tuple[Level, np.ndarray] | None:
    change = np.ones(len(symbols), bool)
    change[1:] = symbols[1:] != symbols[:-1]
    heads = np.flatnonzero(change)
    if len(heads) == len(symbols):
        return None
    first = np.append(heads, len(symbols))
    size = np.diff(first)
    above = _named(symbols[heads] * np.int64(size.max() + 1) + size)
    return Level(symbols, np.cumsum(change) - 1, first, None), above


def _pairs(symbols: np.ndarray, depth: int) -> tuple[Level, np.ndarray]:
    count = int(symbols.max()) + 1
    side = (mix(np.arange(count, dtype=np.uint64) + np.uint64(depth << 40)) & np.uint64(1)).astype(bool)
    right = side[symbols]
    rising, falling = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
    if np.count_nonzero(falling) > np.count_nonzero(rising):
        right, rising = ~right, falling
    head = np.ones(len(symbols), bool)
    head[1:] = ~rising
    heads = np.flatnonzero(head)
    first = np.append(heads, len(symbols))
    keys = symbols[heads] * np.int64(count + 1)
    paired = np.diff(first) == 2
    keys[paired] += symbols[heads[paired] + 1] + 1
    return Level(symbols, np.cumsum(head) - 1, first, right), _named(keys)


class Grammar:
    """The grammar of ``symbols``, whose first and last symbol must occur nowhere else."""

    def __init__(self, symbols: np.ndarray) -> None:
        symbols = _named(np.asarray(symbols))
        self.levels: list[Level] = []
        while len(symbols) and int(symbols.max()) + 1 < len(symbols):  # some symbol occurs twice
            found = _blocks(symbols)
            if found is not None:
                self.levels.append(found[0])
                symbols = found[1]
            if len(symbols) > 1:
                level, symbols = _pairs(symbols, len(self.levels))
                self.levels.append(level)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` on equal those from ``j`` on; i and j differ everywhere."""
        return self._extend(i, j, 1)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to ``i``, read backwards, equal those up to ``j``."""
        return self._extend(i, j, -1)

    def _extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        a, b = i.astype(np.int64), j.astype(np.int64)
        stop = np.full(len(a), len(self.levels))
        going = np.arange(len(a))
        for h, level in enumerate(self.levels):
            if not len(going):
                break
            x, y = a[going], b[going]
            equal = level.symbols[x] == level.symbols[y]
            stop[going[~equal]] = h
            going, x, y = going[equal], x[equal], y[equal]
            if level.right is None:
                p, q = self._run(level, x, way), self._run(level, y, way)
                step = np.minimum(p, q)
                x, y = x + way * step, y + way * step
                a[going], b[going] = x, y
                same = p == q
                stop[going[~same]] = h
                going, x, y = going[same], x[same], y[same]
            else:
                step = way * (level.right[x] == (way > 0))
                x, y = x + step, y + step
            a[going], b[going] = level.up[x], level.up[y]
        for h in range(len(self.levels) - 1, -1, -1):
            down = np.flatnonzero(stop > h)
            if not len(down):
                continue
            level, x, y = self.levels[h], a[down], b[down]
            x, y = (level.first[x], level.first[y]) if way > 0 else (level.first[x + 1] - 1, level.first[y + 1] - 1)
            equal = level.symbols[x] == level.symbols[y]
            if level.right is None:
                step = np.minimum(self._run(level, x, way), self._run(level, y, way)) * equal
            else:
                step = equal
            a[down], b[down] = x + way * step, y + way * step
        return (a - i) * way

    @staticmethod
    def _run(level: Level, at: np.ndarray, way: int) -> np.ndarray:
        """Symbols from a place to the end of its block, itself included."""
        block = level.up[at]
        return level.first[block + 1] - at if way > 0 else at - level.first[block] + 1
