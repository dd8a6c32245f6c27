"""What the two substring operators share: runs of windows that one seed holds together, and the way back to the texts.

A window of K units (words or bytes) is dealt by its seed, the m < K of its units with the least fingerprint: equal
windows have equal seeds, wherever they stand, and consecutive windows mostly share one, so they travel as one *run*.
Seeds only say where windows meet; whether they are equal is told by other means.

A text is known by its doc_id and a fingerprint of the text, which tells rows apart that share a doc_id.  What is
found for a text comes back as one list of places, joined to the text.  Long texts are worked on in chunks that
overlap by a window, so memory follows the chunk; a seed does not depend on where a chunk begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, U64, spread, texts_of

#: Bytes of text that a kernel cuts into runs at once, and window starts that it hashes at once.
BLOCK = 8 << 20
CHUNK = 1 << 20
_PLACE = U64((1 << 24) - 1)
#: Rows for shards: packed runs, and what is settled on the way and only passes through.
SHARD = "shard long, runs binary, settled binary"
FOUND = "doc_id long, tie long, start int, count int"
_CODEC = pa.Codec("zstd", 3)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and tie, which tells rows apart that share a doc_id but not a text: 0 where no doc_id is there twice."""
    texts = texts_of(docs)
    again = texts.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return texts.withColumn("tie", F.lit(0).cast("long") if again.isEmpty() else F.xxhash64("text"))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        values = np.minimum(values[: len(values) - (width - have)], values[width - have :])
    return values


@dataclass
class Runs:
    """Consecutive windows of one row that share a seed: first window, windows, the seed's fingerprint and its place
    after the first window's begin (less than 0: none), and the fingerprint of all units."""

    begin: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray

    def at(self, k: np.ndarray) -> Runs:
        return Runs(*(getattr(self, f)[k] for f in _FIELDS))


_FIELDS = {"begin": np.int64, "count": np.int64, "seed": U64, "anchor": np.int64, "whole": U64}


#: The fingerprints of a block's units at some places.
Units = Callable[[slice | np.ndarray], np.ndarray]


def _chunk_runs(units: np.ndarray, inside: np.ndarray, size: int, seed: int) -> Runs:
    """Runs of one chunk; inside: the window starts whose window lies in one row."""
    prints = RollingHash(units)
    seeds = prints.windows(seed)
    least = _least((seeds & ~_PLACE) | np.arange(len(seeds), dtype=U64), size - seed + 1)
    place = (least[inside] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)))
    last = np.append(first[1:], len(inside)) - 1
    begin = inside[first]
    return Runs(begin, last - first + 1, seeds[place[first]], place[first] - begin, prints.of(begin, inside[last] + size))


def seeded_runs(units: Units, at: np.ndarray, size: int, seed: int) -> Runs:
    """The runs of a block of rows; at: the unit at which each row starts, one place more than rows."""
    n, parts = int(at[-1]), []
    for a in range(0, max(0, n - size + 1), CHUNK):
        b = min(n, a + CHUNK + size - 1)
        outside = np.zeros(b - a - size + 2, np.int32)  # windows that would run over the end of a row
        edges = at[np.searchsorted(at, a, "right") : np.searchsorted(at, b, "left")] - a
        np.add.at(outside, np.clip(edges - size + 1, 0, None), 1)
        np.add.at(outside, np.minimum(edges, b - a - size + 1), -1)
        inside = np.flatnonzero(np.cumsum(outside[:-1]) == 0)
        if len(inside):
            runs = _chunk_runs(units(slice(a, b)), inside, size, seed)
            runs.begin += a
            parts.append(runs)
    return Runs(*(np.concatenate([getattr(p, f) for p in parts]) if parts else np.zeros(0, t) for f, t in _FIELDS.items()))


def opened(runs: Runs, units: Units, size: int, heavy: np.ndarray) -> Runs:
    """The runs, those of heavy seeds as single windows that are dealt by all of their units instead of the seed."""
    at = np.searchsorted(heavy, runs.seed)
    hot = np.flatnonzero(heavy[np.minimum(at, len(heavy) - 1)] == runs.seed) if len(heavy) else []
    if not len(hot):
        return runs
    rest = runs.at(np.setdiff1d(np.arange(len(runs.seed)), hot))
    every, own = [], []
    for part in np.array_split(hot, -(-len(hot) * (2 * size) // CHUNK)):
        begin, count = runs.begin[part], runs.count[part]
        wide = count + size - 1
        prints = RollingHash(units(spread(begin, wide)))
        first = spread(np.cumsum(wide) - wide, count)
        every.append(spread(begin, count))
        own.append(prints.of(first, first + size))
    every, own = np.concatenate(every), np.concatenate(own)
    ones = np.ones(len(every), np.int64)
    single = Runs(every, ones, own, -ones, own)
    return Runs(*(np.concatenate((getattr(rest, f), getattr(single, f))) for f in _FIELDS))


def with_places(docs: DataFrame, places: DataFrame, *more: str) -> DataFrame:
    """The keyed documents with ``places``, the list of (start, count, *more) that ``places`` (doc_id, tie, start, count, *more) has for each, or null.

    A list is as long as its text at most, and rows without a doc_id have none."""
    lists = places.groupBy(F.col("doc_id").alias("of_doc"), F.col("tie").alias("of_tie")).agg(F.collect_list(F.struct("start", "count", *more)).alias("places"))
    met = (F.col("doc_id") == F.col("of_doc")) & (F.col("tie") == F.col("of_tie"))
    return docs.join(lists, met, "left").select("doc_id", "tie", "text", "places")


def listed(column: pa.Array) -> list[np.ndarray]:
    """Row, start, count and what more there is of each place in a column of lists."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    fields = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(flat.type.num_fields)]
    return [np.repeat(np.arange(len(column)), sizes), *fields]


def covered(column: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    """Which units of a block are covered by the windows listed for its rows; at: the unit at which each row starts."""
    row, start, count, *_ = listed(column)
    edges = np.zeros(int(at[-1]) + 1, np.int32)
    np.add.at(edges, at[row] + start, 1)
    np.add.at(edges, at[row] + start + count - 1 + size, -1)
    return np.cumsum(edges[:-1]) > 0


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: an aggregate over one column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n)


def batches_of(columns: dict[str, np.ndarray], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Columns as Arrow batches of bounded rows."""
    n = len(next(iter(columns.values())))
    for a in range(0, n, most):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + most]) for c in columns.values()], list(columns))


# ---------------------------------------------------------------- rows for shards


def packed(*columns: np.ndarray) -> bytes:
    """Columns as one compressed string: the sizes of all, then their bytes."""
    raw = b"".join([np.array([c.nbytes for c in columns], "<i8").tobytes(), *(c.tobytes() for c in columns)])
    return np.array([len(raw)], "<i8").tobytes() + _CODEC.compress(raw, asbytes=True)


def unpacked(held: bytes, *types: str) -> list[np.ndarray]:
    raw = _CODEC.decompress(memoryview(held)[8:], int(np.frombuffer(held, "<i8", 1)[0]), asbytes=True)
    at, out = 8 * len(types), []
    for t, size in zip(types, np.frombuffer(raw, "<i8", len(types)).tolist(), strict=True):
        out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
        at += size
    return out


def shard_row(shard: int, runs: bytes, settled: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([runs], pa.binary()), pa.array([settled], pa.binary())], ["shard", "runs", "settled"])


def dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and what goes there, in its order."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(to[part[0]]), part
