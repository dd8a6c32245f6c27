"""Substring dedup of words on a compacted De Bruijn graph of what repeats.

A window of ``size`` words is an edge, from the node of its first ``size - 1`` words to the node of its last ones;
the fingerprints of these two nodes name it (128 bits).

1. ``shared_places``: every window picks a seed among its words, and windows go on only if another document has
   their seed.  This loses nothing: equal windows have equal seeds.
2. ``met_edges``: the edges at these places meet in the shards of their seeds.  Those that two documents have are
   the graph, each with the coordinates of the least document as its source; where other documents have them in a
   row, and the source has them in a row, they are one piece.
3. ``links``: a node with one repeated edge in and one out, next to each other at the source, joins the two; a node
   where ways part or meet ends a path.
4. ``compacted``: linked edges become paths, inside cells of 64 places bit by bit and from cell to cell by pointer
   doubling, a join of the cells with themselves in each round.
5. ``spans``: pieces in a row become spans: (document, first window, windows, source document, first window there).
6. ``mismatches`` verifies spans at their source: they are cut where paths begin and end, and the digests of the
   words at both places are compared by joins.  Copies share these parts, so there are few different ones however
   many copies name them.  Should a fingerprint ever be shared by different words, all is done again with others.
7. Spans are cut from the documents.

Defined cases: null and empty texts have no words.  Nothing is removed from rows without a doc_id, and nothing
because of them.  Rows with one doc_id do not repeat each other and come out each.  A text of fewer words than a
window keeps all.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import RollingHash, U64, Workspace, _mixed, blocks, spread, word_spans, word_units
from .repeats import BLOCK, CHUNK, FOUND, SHARD, covered, dealt, keyed, listed, packed, seeded_runs, shard_row, text_bytes, unpacked, with_places

COLUMNS = "doc_id long, n_words long, n_removed long, kept string"
#: Words of a part that is verified at once.
PIECE = 64


def _words(data: np.ndarray, at: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, places = word_spans(data, at)
    units = word_units(data, starts, ends) if len(starts) else np.zeros(0, U64)
    return (_mixed(units + U64(salt)) if salt else units), places


def _met(seed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by seed and document, and in that order where each seed begins and whether two documents have it."""
    order = np.lexsort((doc, seed))
    first = np.flatnonzero(np.append(True, seed[order[1:]] != seed[order[:-1]])[: len(order)])
    last = np.append(first[1:], len(order)) - 1
    return order, first, doc[order[first]] < doc[order[last]]


def seed_rows(keyed_docs: DataFrame, size: int, seed: int, salt: int, shards: int) -> DataFrame:
    """For each run of windows its seed, document and place, for the shards; seeds that two documents of a block have
    are settled there, and two entries without a place stand for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, BLOCK):
            units, places = _words(data, at, salt)
            runs = seeded_runs(lambda k: units[k], places, size, seed)
            if not len(runs.begin):
                continue
            row = np.searchsorted(places, runs.begin, "right") - 1
            doc, tie = (rows.column(c).to_numpy()[row] for c in ("doc_id", "tie"))
            start, count = (runs.begin - places[row]).astype("<u4"), runs.count.astype("<u4")
            order, first, shared = _met(runs.seed, doc)
            sizes = np.diff(np.append(first, len(order)))
            every = np.repeat(shared, sizes)
            done = order[every]
            here = np.concatenate((order[~every], order[first[shared]], order[(first + sizes - 1)[shared]]))
            asks = np.concatenate((np.ones(int((~every).sum()), bool), np.zeros(2 * int(shared.sum()), bool)))
            if len(done):
                yield shard_row(int(runs.seed[0] % U64(shards)), b"", packed(doc[done], tie[done], start[done], count[done], runs.seed[done]))
            for shard, part in dealt((runs.seed[here] % U64(shards)).astype(np.int64)):
                k = here[part]
                yield shard_row(shard, packed(runs.seed[k], doc[k], tie[k], start[k], np.where(asks[part], count[k], 0).astype("<u4")), b"")

    return keyed_docs.filter("doc_id is not null").mapInArrow(run, SHARD)


def shared_places(work: Workspace, keyed_docs: DataFrame, size: int, seed: int, salt: int, shards: int) -> DataFrame:
    """doc_id, tie, start, count, seed: the runs whose seed another document has too."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["runs", "settled"]).to_pylist()
        parts = [unpacked(r["settled"], "<i8", "<i8", "<u4", "<u4", "<u8") for r in rows if r["settled"]]
        if held := [unpacked(r["runs"], "<u8", "<i8", "<i8", "<u4", "<u4") for r in rows if r["runs"]]:
            value, doc, tie, start, count = (np.concatenate(c) for c in zip(*held, strict=True))
            order, first, shared = _met(value, doc)
            k = order[np.repeat(shared, np.diff(np.append(first, len(order))))]
            k = k[count[k] > 0]
            parts.append([doc[k], tie[k], start[k], count[k], value[k]])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table({"doc_id": columns[0], "tie": columns[1], "start": columns[2].astype(np.int32), "count": columns[3].astype(np.int32), "seed": columns[4].view(np.int64)})

    return work.write(seed_rows(keyed_docs, size, seed, salt, shards).groupBy("shard").applyInArrow(run, FOUND + ", seed long"), "places")


# ---------------------------------------------------------------- edges


def edge_rows(keyed_docs: DataFrame, places: DataFrame, size: int, salt: int, shards: int) -> DataFrame:
    """The edges at the places for the shards of their seeds: runs (document, tie, start, windows, alone) and their nodes.

    Of equal runs of a block the least document's stands for all; the others repeat it and are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, BLOCK):
            units, first = _words(data, at, salt)
            row, start, count, seed = listed(rows.column("places"))
            if not len(row):
                continue
            doc, tie = (rows.column(c).to_numpy()[row] for c in ("doc_id", "tie"))
            order = np.lexsort((start, tie, doc))
            row, start, count, seed, doc, tie = (x[order] for x in (row, start, count, seed, doc, tie))
            begin = first[row] + start
            whole = _slices(units, begin, begin + count + size - 1)
            stands = np.unique(np.stack((whole.view(np.int64), count), axis=1), axis=0, return_index=True, return_inverse=True)
            source = stands[1][stands[2].ravel()]  # places are in order of documents, so the first one is the least
            again = np.flatnonzero(doc > doc[source])
            if len(again):
                of = source[again]
                yield shard_row(int(seed[0].astype(U64) % U64(shards)), b"", packed(*_places(doc[again], tie[again], start[again], count[again], doc[of], tie[of], start[of])))
            alone = np.ones(len(doc), bool)  # no other document of the block has the run
            alone[source[again]] = False
            own = np.flatnonzero(doc == doc[source])
            for shard, part in dealt((seed[own].astype(U64) % U64(shards)).astype(np.int64)):
                k = own[part]
                node = spread(begin[k], count[k] + 1)
                yield shard_row(shard, packed(doc[k], tie[k], start[k].astype("<u4"), count[k].astype("<u4"), alone[k].astype("u1"), _slices(units, node, node + size - 1)), b"")

    return with_places(keyed_docs, places, "seed").filter("places is not null").mapInArrow(run, SHARD)


def _slices(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of slices of units, chunk by chunk of their order."""
    out = np.empty(len(starts), U64)
    order = np.argsort(starts, kind="stable")
    a = 0
    while a < len(order):
        b = int(np.searchsorted(starts, starts[order[a]] + CHUNK, sorter=order))
        k = order[a:b]
        low, high = int(starts[k[0]]), int(ends[k].max())
        out[k] = RollingHash(units[low:high]).of(starts[k] - low, ends[k] - low)
        a = b
    return out


PIECE_TYPES = ("<i8", "<i8", "<u4", "<u4", "<i8", "<i8", "<u4")


def _places(*columns: np.ndarray) -> list[np.ndarray]:
    """doc_id, tie, start, count, source_doc, source_tie, source_start in the types in which they travel."""
    return [c.astype(t) for c, t in zip(columns, PIECE_TYPES, strict=True)]


def shard_edges(runs: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The edges of a shard that two documents have (from, to, and the least place: document, tie, start), and the runs
    of such edges in other documents with their source (as ``_places``)."""
    doc, tie, start, count, alone, node = (np.concatenate(c) for c in zip(*runs, strict=True))
    count, start = count.astype(np.int64), start.astype(np.int64)
    at = np.cumsum(count + 1) - count - 1
    order = np.lexsort((start, tie, doc))
    doc, tie, start, count, alone, at = (x[order] for x in (doc, tie, start, count, alone, at))
    edge = spread(at, count)
    run = np.repeat(np.arange(len(doc)), count)
    out, into, place = node[edge], node[edge + 1], spread(start, count)
    # edges in order of documents, brought together by a fingerprint of both nodes, or by the nodes should it be shared
    print_ = _mixed(out) + into
    order = np.argsort(print_, kind="stable")
    new = np.append(True, (out[order[1:]] != out[order[:-1]]) | (into[order[1:]] != into[order[:-1]]))
    if (new[1:] & (print_[order[1:]] == print_[order[:-1]])).any():
        order = np.lexsort((into, out))
        new = np.append(True, (out[order[1:]] != out[order[:-1]]) | (into[order[1:]] != into[order[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    d = doc[run[order]]
    shared = (d[first] < d[last]) | ~np.logical_and.reduceat(alone[run[order]] > 0, first)
    least = order[first[shared]]
    graph = [out[least], into[least], doc[run[least]], tie[run[least]], place[least]]
    source = np.full(len(order), -1)
    source[order] = np.repeat(order[first], last - first + 1)
    k = np.flatnonzero(doc[run] > doc[run[source]])  # in order of runs and places again
    s = source[k]
    opens = np.append(True, (run[k[1:]] != run[k[:-1]]) | (k[1:] != k[:-1] + 1) | (run[s[1:]] != run[s[:-1]]) | (place[s[1:]] != place[s[:-1]] + 1))[: len(k)]
    head = np.flatnonzero(opens)
    sizes = np.diff(np.append(head, len(k)))
    k, s = k[head], s[head]
    return graph, _places(doc[run[k]], tie[run[k]], place[k], sizes, doc[run[s]], tie[run[s]], place[s])


MET = "from_node long, to_node long, doc_id long, tie long, start int, count int, source_doc long, source_tie long, source_start int"


def met_edges(work: Workspace, keyed_docs: DataFrame, places: DataFrame, size: int, salt: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """The graph (from_node, to_node, doc, tie, pos) of edges that two documents have, with the least place of each as
    its source; and the pieces (doc_id, tie, start, count, source_doc, source_tie, source_start) that repeat a source."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["runs", "settled"]).to_pylist()
        pieces = [unpacked(r["settled"], *PIECE_TYPES) for r in rows if r["settled"]]
        graph = [np.zeros(0, np.int64)] * 5
        if held := [unpacked(r["runs"], "<i8", "<i8", "<u4", "<u4", "u1", "<u8") for r in rows if r["runs"]]:
            graph, more = shard_edges(held)
            pieces.append(more)
        own = [np.concatenate(c) for c in zip(*pieces, strict=True)] if pieces else _places(*[np.zeros(0, np.int64)] * 7)
        n, m = len(graph[0]), len(own[0])
        long = lambda x, kind: pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)).cast(kind)
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.int32()]
        empty = [pa.nulls(m, k) for k in kinds[:2]], [pa.nulls(n, k) for k in kinds[2:6]]
        upper = [*(long(g, k) for g, k in zip(graph[:2], kinds[:2], strict=True)), *empty[1], *(long(g, k) for g, k in zip(graph[2:], kinds[6:], strict=True))]
        lower = [*empty[0], *(long(c, k) for c, k in zip(own, kinds[2:], strict=True))]
        names = [x.split()[0] for x in MET.split(", ")]
        return pa.table({name: pa.chunked_array([a, b]) for name, a, b in zip(names, upper, lower, strict=True)})

    met = work.write(edge_rows(keyed_docs, places, size, salt, shards).groupBy("shard").applyInArrow(run, MET), "edges")
    graph = met.filter("from_node is not null").select("from_node", "to_node", F.col("source_doc").alias("doc"), F.col("source_tie").alias("tie"), F.col("source_start").alias("pos"))
    return graph, met.filter("from_node is null").drop("from_node", "to_node")


# ---------------------------------------------------------------- paths


def links(graph: DataFrame) -> DataFrame:
    """doc, tie and pos of each edge that a node without branches joins to the edge before it at the source."""
    place = ("doc", "tie", "pos")
    none = [F.lit(None).cast("long" if c != "pos" else "int") for c in place]
    into = graph.select(F.col("to_node").alias("node"), *(F.col(c).alias(f"in_{c}") for c in place), *(n.alias(f"out_{c}") for c, n in zip(place, none, strict=True)))
    out = graph.select(F.col("from_node").alias("node"), *(n.alias(f"in_{c}") for c, n in zip(place, none, strict=True)), *(F.col(c).alias(f"out_{c}") for c in place))
    ways = [F.max(f"{side}_{c}").alias(f"{side}_{c}") for side in ("in", "out") for c in place]
    nodes = into.union(out).groupBy("node").agg(F.count("in_pos").alias("n_in"), F.count("out_pos").alias("n_out"), *ways)
    plain = nodes.filter("n_in = 1 and n_out = 1 and in_doc = out_doc and in_tie = out_tie and in_pos + 1 = out_pos")
    return plain.select(*(F.col(f"out_{c}").alias(c) for c in place))


def compacted(work: Workspace, joined: DataFrame) -> DataFrame:
    """doc, tie, head and end: the first and the last edge of each path of two edges or more.

    The places of a source are dealt to cells of 64, and a cell's linked places are the bits of one number: its runs of
    bits are pieces of paths.  A piece that begins with its cell goes on from the cell before, and from cells that are
    linked whole: it is followed back by pointer doubling, a join of the cells with themselves in each round."""
    bit = lambda i: F.getbit("mask", i).cast("int") == 1
    masks = joined.groupBy("doc", "tie", F.shiftright("pos", 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)))).alias("mask"))
    masks = work.write(masks, "masks")
    every = F.sequence(F.lit(0), F.lit(63))
    first = F.filter(every, lambda i: bit(i) & ((i == 0) | ~bit(F.greatest(i - 1, F.lit(0)))))
    last = F.filter(every, lambda i: bit(i) & ((i == 63) | ~bit(F.least(i + 1, F.lit(63)))))
    parts = masks.select("doc", "tie", "cell", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("x")).select("doc", "tie", "cell", "x.a", "x.b")
    parts = work.write(parts, "parts")
    now = work.write(parts.filter("a = 0").select("doc", "tie", "cell", (F.col("cell") - 1).alias("back"), (F.col("b") == 63).alias("through")), "pointers-0")
    k = 0
    while True:
        jump = now.filter("through").select("doc", "tie", F.col("cell").alias("back"), F.col("back").alias("further"))
        moved = now.join(jump, ["doc", "tie", "back"], "left").select("doc", "tie", "cell", F.coalesce("further", "back").alias("back"), "through", F.col("further").isNotNull().alias("moved"))
        k += 1
        now = work.write(moved, f"pointers-{k}")
        work.drop(f"pointers-{k - 1}")
        if now.filter("moved").isEmpty():
            break
    # the cell that a path comes from holds its first linked place, or only the edge before it
    ends = parts.filter("b = 63 and a > 0").select("doc", "tie", F.col("cell").alias("back"), F.col("a").alias("from"))
    entered = now.join(ends, ["doc", "tie", "back"], "left").select("doc", "tie", "cell", (F.col("back") * 64 + F.coalesce(F.col("from"), F.lit(64)) - 1).alias("entered"))
    head = F.when(F.col("a") == 0, F.col("entered")).otherwise(F.col("cell") * 64 + F.col("a") - 1)
    named = parts.join(entered, ["doc", "tie", "cell"], "left").select("doc", "tie", head.alias("head"), (F.col("cell") * 64 + F.col("b")).alias("last"))
    return named.groupBy("doc", "tie", "head").agg(F.max("last").alias("end"))


def spans(pieces: DataFrame) -> DataFrame:
    """doc_id, tie, start, count, source_doc, source_tie, source_start: pieces in a row whose sources are in a row too."""
    shifted = pieces.select("doc_id", "tie", "start", (F.col("start") + F.col("count")).alias("stop"), "source_doc", "source_tie", (F.col("source_start") - F.col("start")).alias("shift")).distinct()
    of = ["doc_id", "tie", "source_doc", "source_tie", "shift"]
    so_far = Window.partitionBy(*of).orderBy("start", "stop")
    before = F.max("stop").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before >= F.col("start"), F.lit(0)).otherwise(F.lit(1))
    rows = shifted.withColumn("opens", opens).withColumn("island", F.sum("opens").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*of, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return found.select("doc_id", "tie", "start", (F.col("stop") - F.col("start")).alias("count"), "source_doc", "source_tie", (F.col("start") + F.col("shift")).alias("source_start"))


def parts_of(work: Workspace, found: DataFrame, paths: DataFrame, size: int) -> DataFrame:
    """doc_id, tie, start, count (of words), source_doc, source_tie, source_start: the words of spans in parts, cut where
    the source's paths begin and end and at multiples of ``PIECE`` words of the source.

    So copies of a source share their parts, and there are few different ones however many copies name them."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")))
    words = F.col("count") + (size - 1)
    of_span = found.select("*", words.alias("words"), cells(F.col("source_start"), F.col("source_start") + words - 1).alias("cell"))
    of_path = paths.select(F.col("doc").alias("source_doc"), F.col("tie").alias("source_tie"), "head", "end", cells(F.col("head"), F.col("end") + size - 1).alias("cell"))
    edges = of_path.groupBy("source_doc", "source_tie", "cell").agg(F.array_union(F.collect_set("head"), F.collect_set(F.col("end") + size)).alias("cuts"))
    # a table, so that the join is one of two shuffles and adaptive execution can split a source that very many copies have
    met = of_span.join(work.write(edges, "cuts"), ["source_doc", "source_tie", "cell"], "left")
    low = F.greatest("source_start", F.col("cell") * PIECE)
    high = F.least(F.col("source_start") + F.col("words"), (F.col("cell") + 1) * PIECE)
    inside = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > F.col("low")) & (c < F.col("high")))
    cut = met.withColumn("low", low).withColumn("high", high).withColumn("edges", F.array_sort(F.array_distinct(F.concat(F.array("low", "high"), inside))))
    each = cut.select("*", F.posexplode("edges").alias("i", "a")).withColumn("b", F.get("edges", F.col("i") + 1)).filter("b is not null")
    return each.select("doc_id", "tie", (F.col("start") + F.col("a") - F.col("source_start")).alias("start"), (F.col("b") - F.col("a")).alias("count"), "source_doc", "source_tie", F.col("a").alias("source_start"))


def digests(keyed_docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, tie, start, count (of words) and the digest of the words at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches):
            starts, ends, first = word_spans(data, at)
            held = data.tobytes()
            row, start, count, *_ = listed(rows.column("places"))
            said = []
            for a, n in zip((first[row] + start).tolist(), count.tolist(), strict=True):
                words = b" ".join([held[s:e] for s, e in zip(starts[a : a + n].tolist(), ends[a : a + n].tolist(), strict=True)])
                said.append(hashlib.blake2b(words, digest_size=16).digest())
            doc, tie = (rows.column(c).to_numpy()[row] for c in ("doc_id", "tie"))
            columns = [pa.array(doc), pa.array(tie), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(said, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "start", "count", "digest"])

    return with_places(keyed_docs, places).filter("places is not null").mapInArrow(run, "doc_id long, tie long, start int, count int, digest binary")


def mismatches(work: Workspace, keyed_docs: DataFrame, parts: DataFrame) -> DataFrame:
    """The parts of spans whose words are not the words at their source."""
    parts = work.write(parts.distinct(), "verified")
    source = parts.select(F.col("source_doc").alias("doc_id"), F.col("source_tie").alias("tie"), F.col("source_start").alias("start"), "count")
    said = work.write(digests(keyed_docs, parts.select("doc_id", "tie", "start", "count").union(source).distinct()).distinct(), "digests")
    there = said.select(F.col("doc_id").alias("source_doc"), F.col("tie").alias("source_tie"), F.col("start").alias("source_start"), "count", F.col("digest").alias("source_digest"))
    met = parts.join(said, ["doc_id", "tie", "start", "count"], "left").join(there, ["source_doc", "source_tie", "source_start", "count"], "left")
    return met.filter(~F.col("digest").eqNullSafe(F.col("source_digest")) | F.col("digest").isNull())


def repeated_words(work: Workspace, keyed_docs: DataFrame, size: int, seed: int, shards: int, salt: int = 0) -> DataFrame:
    """Verified spans of the documents' words that stand in a lesser document."""
    graph, pieces = met_edges(work, keyed_docs, shared_places(work, keyed_docs, size, seed, salt, shards), size, salt, shards)
    work.drop("places")
    paths = work.write(compacted(work, links(graph)), "paths")
    found = work.write(spans(pieces), f"spans-{salt}")
    work.drop("edges")
    if mismatches(work, keyed_docs, parts_of(work, found, paths, size)).isEmpty():
        return found
    return repeated_words(work, keyed_docs, size, seed, shards, salt + 1)


def _finish(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray, size: int) -> pa.RecordBatch:
    starts, ends, places = word_spans(data, at)
    gone = covered(rows.column("places"), places, size)
    held = data.tobytes()
    removed, kept = [], []
    for k in range(rows.num_rows):
        a, b = int(places[k]), int(places[k + 1])
        stay = a + np.flatnonzero(~gone[a:b])
        removed.append(b - a - len(stay))
        kept.append(b" ".join([held[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
    columns = [rows.column("doc_id"), pa.array(np.diff(places).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def drop_repeated_words(spark: SparkSession, docs: DataFrame, size: int = 13, seed: int = 8, shard_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, a space between them) for each row."""
    keyed_docs = keyed(docs)
    shards = max(1, -(-text_bytes(keyed_docs) // shard_bytes))
    found = repeated_words(Workspace(spark, "words"), keyed_docs, size, seed, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches):
            yield _finish(rows, data, at, size)

    return with_places(keyed_docs, found).mapInArrow(run, COLUMNS)
