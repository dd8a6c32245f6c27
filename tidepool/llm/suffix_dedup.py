"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

1. Every text is cut into runs of windows of ``size`` bytes that share a seed, and a run's bytes go to the shard
   that its seed names, so equal windows meet in one shard.  Equal runs of a block, compared byte by byte, go as
   one: the least document stands for the others, whose windows are repeats.
2. A shard takes its runs as batches, leaving out those whose seed no other document has: they can match nothing.
   Nothing else is left out: of all other runs every byte at which a window starts is a suffix.  A batch gets its suffix array: all its suffixes in the order of their
   first ``size`` bytes.  It is merge-scanned against the level of its size: both are sorted, so one merge puts
   suffixes with a common prefix of ``size`` bytes next to each other; the least document keeps the string, and
   the suffixes of others are repeats and leave the index.  The two become a level of the next size, which meets
   the level there, and so on; at the end the levels that are left merge from the smallest up.  So a suffix takes
   part in about log2(batches) merges, and every batch has met every other.
3. What is repeated goes back to the texts, which are cut where they lie.

Seeds that would make a shard too large, told by a sample of documents, are opened: their windows are dealt by
all of their bytes.  The sample decides only where windows meet.  Shards have a bounded number of bytes of text,
so more text is more shards and not larger ones; one string costs a shard one run for each block that holds it.

Defined cases: null and empty texts have no bytes.  Nothing is removed from rows without a doc_id, and nothing
because of them.  Rows with one doc_id do not repeat each other and come out each.  A text shorter than a window
keeps all.  Matches never cross documents.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Workspace, blocks, byte_units, spread
from .repeats import BLOCK, FOUND, SHARD, Runs, batches_of, covered, dealt, keyed, opened, packed, seeded_runs, shard_row, text_bytes, unpacked, with_places

COLUMNS = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, size: long>>, kept binary"
#: Suffixes of a batch, and of a sample's documents one in so many.
BATCH = 1 << 18
SAMPLED = 64


# ---------------------------------------------------------------- runs on their way to shards


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes at a are those at b, for each."""
    out = np.ones(len(a), bool)
    for part in np.array_split(np.arange(len(a)), -(-int(size.sum()) // BLOCK)) if len(a) else []:
        n = size[part]
        same = data[spread(a[part], n)] == data[spread(b[part], n)]
        out[part] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def _groups(runs: Runs, doc: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in an order in which equal ones follow each other, the least document first; for each the place in
    that order of the first run of its bytes, and of the first of its bytes and document."""
    order = np.lexsort((runs.begin, doc, runs.whole))
    whole, doc, begin, width = runs.whole[order], doc[order], runs.begin[order], runs.count[order] + size - 1
    new = np.append(True, whole[1:] != whole[:-1])[: len(order)]
    while True:
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rest = np.flatnonzero(~new)
        bad = rest[width[rest] != width[first[rest]]]
        same = rest[width[rest] == width[first[rest]]]
        bad = np.append(bad, same[~_equal_bytes(data, begin[same], begin[first[same]], width[same])])
        if not len(bad):
            break
        new[bad] = True  # a fingerprint that different bytes share: each run for itself
    own = new | np.append(True, doc[1:] != doc[:-1])[: len(order)]
    return order, first, np.maximum.accumulate(np.where(own, np.arange(len(own)), 0))


def shard_rows(docs: DataFrame, size: int, seed: int, shards: int, heavy: np.ndarray) -> DataFrame:
    """The runs of all documents for the shards: entries (document, windows, place of the seed, places), their places (tie, start) and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, BLOCK):
            doc, tie = rows.column("doc_id").to_numpy(), rows.column("tie").to_numpy()
            units = lambda k: byte_units(data[k])
            runs = opened(seeded_runs(units, at, size, seed), units, size, heavy)
            if not len(runs.begin):
                continue
            row = np.searchsorted(at, runs.begin, "right") - 1
            order, first, own = _groups(runs, doc[row], data, size)
            runs, row = runs.at(order), row[order]
            start, ties = (runs.begin - at[row]).astype("<u4"), tie[row]
            place = np.arange(len(first))
            settled = np.flatnonzero(doc[row] > doc[row[first]])
            # what stays: an entry for the least document of each run, its places in that document after one another
            stays = doc[row] == doc[row[first]]
            entry = np.flatnonzero(stays & (own == place))
            n_places = np.bincount(own[stays], minlength=len(own))[entry]
            to = ((runs.seed[entry] >> U64(20)) % U64(shards)).astype(np.int64)
            if len(settled):
                yield shard_row(int(to[0]), b"", packed(doc[row[settled]].astype("<i8"), ties[settled].astype("<i8"), start[settled], runs.count[settled].astype("<u4")))
            for shard, part in dealt(to):
                e, n = entry[part], n_places[part]
                held = spread(e, n)
                text = data[spread(runs.begin[e], runs.count[e] + size - 1)]
                own = (doc[row[e]].astype("<i8"), runs.count[e].astype("<u4"), runs.anchor[e].astype("<i2"), n.astype("<u4"))
                yield shard_row(shard, packed(*own, ties[held].astype("<i8"), start[held], text), b"")

    return docs.filter("doc_id is not null").mapInArrow(run, SHARD)


def heavy_seeds(docs: DataFrame, size: int, seed: int, most_runs: int) -> np.ndarray:
    """Seeds that more than most_runs runs have by a sample of one document in ``SAMPLED``: at most as many as there are shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in blocks(batches, BLOCK):
            runs = seeded_runs(lambda k: byte_units(data[k]), at, size, seed)
            _, once = np.unique(runs.whole, return_index=True)  # equal runs of a block go as one
            value, n = np.unique(runs.seed[once], return_counts=True)
            yield from batches_of({"seed": value.view(np.int64), "n": n.astype(np.int64)})

    sample = docs.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0))
    counts = sample.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.seed for r in counts.filter(F.col("n") * SAMPLED > most_runs).select("seed").collect()], np.int64).view(U64))


# ---------------------------------------------------------------- suffix arrays and levels


@dataclass
class SuffixArray:
    """Suffixes in the order of their first bytes: these bytes, the document, and which window of which entry each is."""

    keys: np.ndarray
    doc: np.ndarray
    entry: np.ndarray
    window: np.ndarray

    def at(self, k: np.ndarray) -> SuffixArray:
        return SuffixArray(self.keys[k], self.doc[k], self.entry[k], self.window[k])

    def __len__(self) -> int:
        return len(self.keys)


def suffix_array(text: np.ndarray, doc: np.ndarray, count: np.ndarray, of: np.ndarray, size: int) -> SuffixArray:
    """The suffix array of a batch of entries (of), whose bytes (count + size - 1 for each) follow each other in text."""
    width = count + size - 1
    starts = spread(np.cumsum(width) - width, count)
    keys = np.ascontiguousarray(sliding_window_view(text, size)[starts]).view(f"S{size}").ravel()
    entry = np.repeat(np.arange(len(count)), count)
    window = spread(np.zeros(len(count), np.int64), count)
    order = np.argsort(keys)
    return SuffixArray(keys[order], doc[entry[order]], of[entry[order]].astype(np.uint32), window[order].astype(np.uint32))


def scanned(index: SuffixArray) -> tuple[SuffixArray, SuffixArray | None]:
    """What stays of suffixes in order, and the repeats: neighbours with a common prefix of all bytes, of which a lesser document has one."""
    if not len(index):
        return index, None
    new = np.append(True, index.keys[1:] != index.keys[:-1])
    first = np.flatnonzero(new)
    if len(first) == len(new):
        return index, None
    least = np.repeat(np.minimum.reduceat(index.doc, first), np.diff(np.append(first, len(new))))
    repeat = index.doc > least
    return (index.at(~repeat), index.at(repeat)) if repeat.any() else (index, None)


def merged(a: SuffixArray, b: SuffixArray) -> SuffixArray:
    """Two arrays in order as one; a stable sort of two sorted runs is their merge."""
    keys = np.concatenate((a.keys, b.keys))
    order = np.argsort(keys, kind="stable")
    return SuffixArray(keys[order], *(np.concatenate((getattr(a, f), getattr(b, f)))[order] for f in ("doc", "entry", "window")))


class IndexFamily:
    """Levels of geometrically growing size, each a suffix array; what merges find is kept in ``found``."""

    def __init__(self) -> None:
        self.levels: list[SuffixArray | None] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def _settle(self, index: SuffixArray) -> SuffixArray:
        kept, repeats = scanned(index)
        if repeats is not None:
            self.found.append((repeats.entry, repeats.window))
        return kept

    def add(self, batch: SuffixArray) -> None:
        """A batch meets the level of its size, the two the next one, and so on."""
        batch, at = self._settle(batch), 0
        while at < len(self.levels) and (level := self.levels[at]) is not None:
            self.levels[at] = None
            batch, at = self._settle(merged(level, batch)), at + 1
        if at == len(self.levels):
            self.levels.append(None)
        self.levels[at] = batch

    def close(self) -> None:
        """The levels that are left meet each other, smaller ones first."""
        whole = None
        for at, level in enumerate(self.levels):
            if level is not None:
                whole = level if whole is None else self._settle(merged(level, whole))
            self.levels[at] = None
        self.levels = [whole]


@dataclass
class Entries:
    """Runs that reached a shard: document, windows, place of the seed, places of equal runs in that document, bytes."""

    doc: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    n_places: np.ndarray
    tie: np.ndarray
    start: np.ndarray
    text: np.ndarray

    def first_bytes(self, size: int) -> np.ndarray:
        width = self.count + size - 1
        return np.cumsum(width) - width


def shared_seeds(entries: Entries, size: int, seed: int) -> np.ndarray:
    """Which runs have a seed that another document has here too; a run without a seed is always taken."""
    out = entries.anchor < 0
    own = np.flatnonzero(~out)
    at = entries.first_bytes(size)[own] + entries.anchor[own]
    if len(own):
        seeds = np.ascontiguousarray(sliding_window_view(entries.text, seed)[at]).view(f"S{seed}").ravel()
        order = np.argsort(seeds)
        first = np.flatnonzero(np.append(True, seeds[order[1:]] != seeds[order[:-1]]))
        doc = entries.doc[own[order]]
        more = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        out[own[order]] = np.repeat(more, np.diff(np.append(first, len(own))))
    return out


def batches(entries: Entries, size: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs that can meet another document's, in batches of about ``BATCH`` windows: entries, documents, windows and bytes."""
    chosen = np.flatnonzero(shared_seeds(entries, size, seed))
    at = entries.first_bytes(size)
    ends = np.cumsum(entries.count[chosen])
    for part in np.split(chosen, np.searchsorted(ends, np.arange(BATCH, int(ends[-1]), BATCH))) if len(chosen) else []:
        if len(part):
            count = entries.count[part]
            yield part, entries.doc[part], count, entries.text[spread(at[part], count + size - 1)]


def shard_repeats(rows: list[dict], size: int, seed: int) -> dict[str, np.ndarray]:
    """doc_id, tie, start and count of the repeated windows of one shard, consecutive ones together."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint32)] * 2]
    parts += [unpacked(row["settled"], "<i8", "<i8", "<u4", "<u4") for row in rows if row["settled"]]
    if runs := [unpacked(row["runs"], "<i8", "<u4", "<i2", "<u4", "<i8", "<u4", "u1") for row in rows if row["runs"]]:
        doc, count, anchor, n, tie, start, text = (np.concatenate(x) for x in zip(*runs, strict=True))
        entries = Entries(doc, count.astype(np.int64), anchor.astype(np.int64), n.astype(np.int64), tie, start, text)
        family = IndexFamily()
        for of, d, c, t in batches(entries, size, seed):
            family.add(suffix_array(t, d, c, of, size))
        family.close()
        if family.found:
            parts.append(_placed(entries, *(np.concatenate(x).astype(np.int64) for x in zip(*family.found, strict=True))))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return {"doc_id": columns[0], "tie": columns[1], "start": columns[2].astype(np.int32), "count": columns[3].astype(np.int32)}


def _placed(entries: Entries, entry: np.ndarray, window: np.ndarray) -> list[np.ndarray]:
    """doc_id, tie, start and count of windows of entries, at every place of each entry, consecutive ones together."""
    order = np.lexsort((window, entry))
    entry, window = entry[order], window[order]
    first = np.flatnonzero(np.append(True, (entry[1:] != entry[:-1]) | (window[1:] != window[:-1] + 1)))
    count = np.diff(np.append(first, len(entry)))
    entry, window = entry[first], window[first]
    n = entries.n_places
    place = spread((np.cumsum(n) - n)[entry], n[entry])
    again = np.repeat(np.arange(len(entry)), n[entry])
    return [entries.doc[entry[again]], entries.tie[place], entries.start[place] + window[again].astype(np.uint32), count[again].astype(np.uint32)]


def repeated_bytes(work: Workspace, keyed_docs: DataFrame, size: int, seed: int, shard_bytes: int) -> DataFrame:
    """doc_id, tie, start, count: windows of each text that also start in a document with a lesser doc_id."""
    shards = max(1, -(-text_bytes(keyed_docs) // shard_bytes))
    # a run is some 20 windows; a seed that alone would fill a shard is opened
    heavy = heavy_seeds(keyed_docs, size, seed, shard_bytes // 16) if shards > 1 else np.zeros(0, U64)

    def run(table: pa.Table) -> pa.Table:
        return pa.table(shard_repeats(table.select(["runs", "settled"]).to_pylist(), size, seed))

    return work.write(shard_rows(keyed_docs, size, seed, shards, heavy).groupBy("shard").applyInArrow(run, FOUND), "found")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))


def _finish(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    off = np.concatenate(([False], gone, [False]))
    opens, closes = np.flatnonzero(off[1:-1] & ~off[:-2]), np.flatnonzero(off[1:-1] & ~off[2:]) + 1
    edges = at[1:-1]  # a span ends with its row
    both = edges[(edges > 0) & (edges < len(gone))]
    both = both[gone[both] & gone[both - 1]]
    opens, closes = np.union1d(opens, both), np.union1d(closes, both)
    row = np.searchsorted(at, opens, "right") - 1
    n_spans = np.bincount(row, minlength=rows.num_rows)
    spans = pa.StructArray.from_arrays([pa.array(opens - at[row]), pa.array(closes - opens)], ["start", "size"])
    kept_at = np.append(0, np.cumsum(~gone))[at]
    kept = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(kept_at.astype(np.int32)), pa.py_buffer(data[~gone])])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_spans)).astype(np.int32)), spans).cast(_SPANS)
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(at) - np.diff(kept_at)), lists, kept], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, size: int = 50, seed: int = 14, shard_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs) and kept (the remaining bytes) for each row."""
    keyed_docs = keyed(docs)
    found = repeated_bytes(Workspace(spark, "bytes"), keyed_docs, size, seed, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches):
            yield _finish(rows, data, at, covered(rows.column("places"), at, size))

    return with_places(keyed_docs, found).mapInArrow(run, COLUMNS)
