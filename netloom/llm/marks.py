"""Bitmaps that say which 64-bit numbers several rows have, made with few bytes shuffled and gathered nowhere.

A task sorts the numbers of many rows at once and sends a bucket's share of them as one value: 32 bits each behind the
bucket's own, bytes of equal weight side by side, so that the first ones of sorted numbers compress. A bucket's group
sorts what it got and sets the bits of the numbers it got often enough. Bitmaps have false positives (other numbers with
the same first bits), never false negatives: they spare rows, and what they let through has to be judged exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from netloom.llm import near

#: A bitmap has a bit for this many bytes of text, up to 2**MOST_PLACES bits (128 MB); numbers that a task sorts at once.
TEXT_BYTES, MOST_PLACES, HELD = 4, 30, 1 << 20
#: Tables of so many ids and keys at most are broadcast instead (some 16 MB in the driver).
FEW = 100_000
_U = np.uint64


def places_for(text_bytes: int) -> tuple[int, int]:
    """Of a bitmap, and of a bucket's number, the bits; a bucket for every 32 MB of text, 256 at least."""
    places = min(max((text_bytes // TEXT_BYTES).bit_length(), 16), MOST_PLACES)
    return places, min(max((text_bytes >> 25).bit_length(), 8), places - 3)


def places_of(numbers: int) -> tuple[int, int]:
    """`places_for` of so many numbers: four to eight bits for each."""
    return places_for(4 * TEXT_BYTES * numbers)


def marked(df: DataFrame, start: Callable[[], Callable], sizes: tuple[int, int], copies: int) -> Broadcast:
    """Bitmap of the numbers that ``copies`` rows have (one or two), broadcast in parts; `reader` reads it.

    ``start()`` gives, once a task, the function from an Arrow batch to arrays of numbers, each of them distinct.
    """
    places, high = sizes

    def pack(batches):
        make, held, n = start(), [], 0

        def packed():
            x = np.sort(near.mix(np.concatenate(held)))
            fresh = np.ones(len(x), bool)
            fresh[copies:] = x[copies:] != x[:-copies]
            x = x[fresh]
            edges = np.searchsorted(x, np.arange(1, 1 << high, dtype=_U) << _U(64 - high))
            parts = np.split((x >> _U(32 - high)).astype(np.uint32), edges)
            full = [k for k, part in enumerate(parts) if len(part)]
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()),
                 pa.array([parts[k].view(np.uint8).reshape(-1, 4).T.tobytes() for k in full], pa.binary())],
                names=["bucket", "numbers"])
        for given in batches:
            for own in make(given):
                held.append(own)
                n += len(own)
                if n >= HELD:
                    yield packed()
                    held, n = [], 0
        if n:
            yield packed()

    def mark(table):
        bucket, bits = table.column("bucket")[0].as_py(), places - high
        x = np.sort(np.concatenate([np.frombuffer(part, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
                                    for part in table.column("numbers").to_pylist()]))
        often = x[copies - 1:][x[copies - 1:] == x[:len(x) - copies + 1]]
        out = np.zeros(1 << bits, bool)
        out[often >> np.uint32(32 - bits)] = True
        return pa.table({"bucket": pa.array([bucket], pa.int32()),
                         "bits": pa.array([zlib.compress(np.packbits(out, bitorder="little").tobytes(), 1)], pa.binary())})

    buckets = df.mapInArrow(pack, "bucket int, numbers binary").groupBy("bucket").applyInArrow(mark, "bucket int, bits binary")
    parts = dict(map(tuple, buckets.collect()))         # a bitmap in all, 128 MB at most
    none = zlib.compress(bytes(1 << places - high - 3), 1)
    return df.sparkSession.sparkContext.broadcast((places, [parts.get(k, none) for k in range(1 << high)]))


def reader(shared: Broadcast) -> Callable[[np.ndarray], np.ndarray]:
    """The function that tells, for an array of numbers, which ones the bitmap has (and a few others)."""
    places, parts = shared.value
    bits = np.frombuffer(b"".join(map(zlib.decompress, parts)), np.uint8)

    def has(x: np.ndarray) -> np.ndarray:
        at = near.mix(x) >> _U(64 - places)
        return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return has


def member(wanted: DataFrame, *columns: str) -> Callable[..., Column]:
    """The condition, for such columns of any table, that ``wanted`` has a row of these values (true for a few others, too).

    In place of a broadcast of ``wanted``, which is read twice: a join behind it moves and judges few rows.
    """
    n = wanted.count()
    numbers, sizes = wanted.select(F.xxhash64(*columns)).coalesce(max(1, n // HELD)), places_of(4 * n)

    def of_rows(given):
        yield given.column(0).to_numpy(zero_copy_only=False).view(_U)
    bits = marked(numbers, lambda: of_rows, sizes, 1)

    @F.arrow_udf("boolean")
    def has(given: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = reader(bits)
        for numbers in given:
            yield pa.array(known(numbers.to_numpy(zero_copy_only=False).view(_U)))
    return lambda *own: has(F.xxhash64(*own))
