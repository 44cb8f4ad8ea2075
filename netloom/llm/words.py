"""Words of many texts at once, as arrays: their places and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import xxhash

from netloom.llm import near

#: Bytes of text that are turned into arrays at once (a longer text is taken alone); bytes of a word hashed in arrays.
HELD, LONG = 1 << 18, 64
_U = np.uint64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


class Words(NamedTuple):
    """Texts side by side, with a line break before the first and after each of them.

    ``breaks`` are the places of all line breaks, ``texts`` the numbers of those before each text and after the last;
    ``lines`` and ``bounds`` give the first word behind each break and of each text, ``hashes`` a number for each word.
    """
    data: bytes
    breaks: np.ndarray
    texts: np.ndarray
    lines: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def words(texts: list[bytes | None]) -> Words:
    """What bytes.split takes for words, with ASCII letters in lower case."""
    given = [t or b"" for t in texts]
    data = b"\n".join([b"", *given, b" " * 8])      # the tail lets eight bytes be read at any place
    lower = data.lower()
    x = np.frombuffer(lower, np.uint8)
    space = _SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, end = edge[::2], edge[1::2]
    size = end - first
    eight = np.ndarray(len(x) - 7, "<u8", lower, 0, (1,))
    h = near.mix(size.astype(_U)) ^ eight[first] & _FIRST[np.minimum(size, 8)]
    h, at, done = near.mix(h), np.flatnonzero(size > 8), 8
    while len(at) and done < LONG:
        left = size[at] - done
        h[at] = near.mix(h[at] * _U(0xD6E8FEB86659FD93) ^ eight[first[at] + done] & _FIRST[np.minimum(left, 8)])
        at, done = at[left > 8], done + 8
    for k in at:
        h[k] = xxhash.xxh64_intdigest(lower[first[k]:end[k]])
    breaks = np.flatnonzero(x == 10)
    lines = np.searchsorted(first, breaks)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in given], dtype=np.int64)))
    numbers = np.searchsorted(breaks, starts)
    return Words(data, breaks, numbers, lines, lines[numbers], h)


def parts(given, column: str) -> Iterator:
    """Slices of an Arrow batch with about HELD bytes in ``column``."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(given.column(column)), 0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // HELD)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), given.num_rows]):
        yield given.slice(a, b - a)
