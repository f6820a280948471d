"""Words of many texts as numbers and as 128-bit names that are the same in every task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import xxhash

#: Odd 64-bit multipliers: of rolling names, and of the mixing that follows them.
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Numbers words (bytes) in the order in which they come, so ``[words[w] for w in ...]`` never fails."""

    def __init__(self) -> None:
        super().__init__()
        self._names = np.empty((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def names(self) -> np.ndarray:
        """(n, 2): two 64-bit names of each word, by number."""
        new = b"".join(map(xxhash.xxh3_128_digest, islice(self, len(self._names), None)))
        self._names = np.concatenate([self._names, np.frombuffer(new, ">u8").astype(np.uint64).reshape(-1, 2)])
        return self._names


def mixed(x: np.ndarray) -> np.ndarray:
    """Names whose high bits depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    return (x ^ (x >> np.uint64(29))) * ROLL


def rolled(names: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For k = 1, 2 ... ``longest``: the names of the runs of k words that start at each place."""
    now = names
    for k in range(1, longest + 1):
        if k > 1:
            now = now[: max(0, len(now) - 1)] * ROLL + names[k - 1 :]
        yield now


def in_parts(rows: Iterable, size, most: int) -> Iterator[list]:
    """``rows`` in lists whose sizes together just reach ``most``, so that a part's memory is bounded by that and one row."""
    part, n = [], 0
    for r in rows:
        part.append(r)
        n += size(r)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part
