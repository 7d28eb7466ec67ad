"""Texts as runs of white-space chunks, with per-chunk figures kept in a bounded cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

MAX_CHUNKS = 500_000
LINE_END = "\x00"


class Chunks(dict):
    """Chunk -> row of `figures`, made by `describe` when first met; emptied beyond `most` chunks."""

    def __init__(self, describe: Callable[[str], tuple], width: int, most: int = MAX_CHUNKS) -> None:
        super().__init__()
        self.describe = describe
        self.most = most
        self.figures = np.zeros((4096, width), dtype=np.float64)

    def __missing__(self, chunk: str) -> int:
        n = len(self)
        if n == len(self.figures):
            self.figures = np.concatenate([self.figures, np.zeros_like(self.figures)])
        self.figures[n] = self.describe(chunk)
        self[chunk] = n
        return n

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of figures for all chunks of the texts, one after the other, and where each text starts.  A line's end is a chunk of its own."""
        self.trim()
        split = [t.replace("\n", f" {LINE_END} ").split() for t in texts]
        lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(lengths.sum()))
        return codes, np.concatenate([[0], np.cumsum(lengths)])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between each two bounds, 0 where there are none."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def slices(batch, rows: int = 256) -> Iterator:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
