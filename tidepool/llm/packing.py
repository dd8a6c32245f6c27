"""Packing of documents into fixed windows by best fit decreasing.

Each text is encoded once, where it lies.  A document longer than a window is first cut into full
windows, which need no packing; what is left of it (less than a window) is one piece.  Only the sizes
of pieces are shuffled.  Pieces are dealt by a hash into groups of about ``group_docs`` documents' pieces, so
that no task grows with the corpus, however many rows share a doc_id or have none, and inside a group the pieces are placed from the
longest to the shortest, each into the open window with the least room that still holds it.  A segment
tree over the room left finds that window in log2(window) steps.

Null and empty texts are one piece, the end token alone.  Rows with equal or null doc_id are packed each
for itself.  Ties in length are broken by doc_id and start.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, texts_of
from .token_counts import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, json_path: str, window: int, end_id: int = 0) -> DataFrame:
    """The pieces of each document: full windows and the rest, with a checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json_path)
        for batch, _, _ in blocks(batches):
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(enc.ids(text), np.uint32(end_id)).astype("<u4")
                rows += [(doc, s, len(x := ids[s : s + window]), zlib.crc32(x.tobytes()), len(ids)) for s in range(0, len(ids), window)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts_of(docs).mapInArrow(run, PIECE)


class RoomTree:
    """Open windows by the room that is left in them; finds the tightest that holds a piece."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)  # open windows below each node
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.open[node] += by
            node >>= 1

    def add(self, number: int, room: int) -> None:
        self.windows[room].append(number)
        self._count(room, 1)

    def tightest(self, size: int) -> int | None:
        """The least room of at least size among open windows."""
        node = self.leaves + size
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):  # up until something lies to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> int:
        self._count(room, -1)
        return self.windows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in order of falling length: the window of each and its offset there."""
    into, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = RoomTree(window), 0
    for k, size in enumerate(lengths.tolist()):
        if size == window:
            into[k], opened = opened, opened + 1
            continue
        room = tree.tightest(size)
        if room is None:
            number, room, opened = opened, window, opened + 1
        else:
            number = tree.take(room)
        into[k], offset[k] = number, window - room
        if room > size:
            tree.add(number, room - size)
    return into, offset


def pack(docs: DataFrame, json_path: str, window: int = 1024, group_docs: int = 8192, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, json_path, window, end_id)
    # equal pieces, of rows without a doc_id or with one that is there again, are counted before they are dealt, each to a place of its own
    same = [c.split()[0] for c in PIECE.split(", ")]
    every = cut.groupBy(*same).agg(F.count("*").cast("int").alias("n")).select(*same, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    dealt = every.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "copy"), F.lit(groups))).drop("copy")

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        into, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.drop(columns="pack_group").assign(sequence_id=into * groups + int(key[0]), offset=offset)

    return dealt.groupBy("pack_group").applyInPandas(place, PIECE + ", sequence_id long, offset long")
