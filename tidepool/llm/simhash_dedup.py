"""SimHash near-duplicates by an inverted index on the bytes of fingerprints.

A fingerprint of B bytes is B postings (position, value).  Two fingerprints that differ in at most e bits
share at least B - e positional bytes, and pairs are told by counting the bytes that they share.  Counting
over single postings would tally every pair of a 256th of the corpus, so postings are joined by threes
(position, position, position, values): among any ``B - e`` shared positions at least one posting of a
covering set of triples lies wholly, by Turan's construction for B - e = 4 of 8.  Where fingerprints are
longer and no number of shared bytes is guaranteed, a fixed number of triples reaches a stated recall.
Pairs that meet in a posting are tallied (shared bytes) and verified (differing bits).

Equal fingerprints are one class before anything is paired, so copies cost nothing.  Only distinct
fingerprints that agree in three bytes meet in a task.  There, neighbours in several sort orders are
linked first and pairs are compared only across the parts that remain apart; a posting yields a spanning
forest of its links, not all pairs.  Components are then found by alternating stars.

Defined cases: null and empty texts have fingerprint zero, linked like any other.  Rows without a doc_id link
others and get the least doc_id that they reach, or null.  Rows with one doc_id come out each.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, _mixed, blocks, texts_of
from .components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 50_000
_ROWS = 255


def simhash(text: str, words: int = 4, n_bytes: int = 8, seed: int = 42, distinct: bool = False) -> bytes:
    """Majority bits of the XXH64 of all word shingles, or of the distinct ones; beyond 8 bytes, of further mixings of each hash."""
    found = text.encode().translate(_LOWER).split()  # bytes split at [\x20\x09-\x0D]
    if not found:
        return bytes(n_bytes)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(found))
    places = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in places]), ">u8")
    if distinct:
        hashes = np.unique(hashes)
    counts = np.zeros(8 * n_bytes, np.int64)
    more = (np.arange(n_bytes // 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(hashes), _ROWS):  # so few rows that a byte holds the sum of their bits
        part = hashes[at : at + _ROWS].astype(np.uint64)[:, None]
        x = np.concatenate((part, _mixed(part + more[:, 1:])), axis=1).astype(">u8")
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words: int, n_bytes: int) -> DataFrame:
    """doc_id and fp for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in blocks(batches):
            fps = [simhash(x, words, n_bytes) for x in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp binary")


def covering_triples() -> list[tuple[int, ...]]:
    """20 triples of 8 positions such that any 4 positions contain one: Turan's construction on groups of 3, 3 and 2."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [g for g in groups if len(g) == 3]
    for i, g in enumerate(groups):
        out += [(a, b, c) for a, b in combinations(g, 2) for c in groups[(i + 1) % 3]]
    return [tuple(sorted(x)) for x in out]


def spread_triples(n_bytes: int, count: int, seed: int = 5) -> list[tuple[int, ...]]:
    """count different triples of positions, drawn evenly."""
    every = list(combinations(range(n_bytes), 3))
    return [every[i] for i in sorted(np.random.default_rng(seed).permutation(len(every))[:count].tolist())]


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints as rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positional bytes that fingerprints share."""
    return (np.ascontiguousarray(a).view(np.uint8).reshape(*a.shape[:-1], -1) == np.ascontiguousarray(b).view(np.uint8).reshape(*b.shape[:-1], -1)).sum(axis=-1)


def linked(a: np.ndarray, b: np.ndarray, max_bits: int, least_shared: int) -> np.ndarray:
    """Count filter, then verification of what it retains."""
    kept = np.flatnonzero(_shared(a, b) >= least_shared)
    return kept[_differing(a[kept], b[kept]) <= max_bits]


def _spanning(fp: np.ndarray, max_bits: int, least_shared: int, steps: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among all fingerprints of one large posting, closer ones in earlier steps."""
    n, links = len(fp), []
    forest = _Forest(n)

    def add(i: np.ndarray, j: np.ndarray) -> None:
        links.extend((a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if forest.join(a, b))

    size = fp.view(np.uint8).reshape(n, -1)
    orders = [np.lexsort(np.roll(size, -turn, axis=1).T[::-1]) for turn in range(size.shape[1])]
    for part in range(1, steps + 1):
        for order in orders:  # neighbours in orders that begin at each byte
            for step in (1, 2, 3):
                a, b = order[:-step], order[step:]
                k = linked(fp[a], fp[b], max_bits * part // steps, least_shared)
                add(a[k], b[k])
    parts = np.array([forest.find(i) for i in range(n)])
    names, sizes = np.unique(parts, return_counts=True)
    largest = names[sizes.argmax()]
    for i in np.flatnonzero(parts != largest).tolist():  # whatever may link a part to another has an end outside the largest
        others = np.flatnonzero(parts != parts[i])
        k = linked(np.broadcast_to(fp[i], (len(others), fp.shape[1])), fp[others], max_bits, least_shared)
        add(np.full(len(k), i), others[k])
    return links


def links(classes: DataFrame, triples: list[tuple[int, ...]], max_bits: int, least_shared: int, large: int = 16, steps: int = 1, tell: bool = False, carried: int | None = None) -> DataFrame:
    """Pairs (a, b) of class representatives that span all links found in any posting; classes: rep, fp.

    Postings are by triples of positions of the whole fingerprint; its first ``carried`` bytes, or all, go with a
    posting, and links are told by them.

    tell adds the column large: whether the pair comes from a forest, which stands for more links than it has.
    """
    chosen = np.array(triples)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _CHUNK // len(chosen))  # an Arrow batch of postings stays small
        for batch in (x.slice(k, step) for x in batches for k in range(0, x.num_rows, step)):
            n = batch.num_rows
            fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
            keys = np.arange(len(chosen)) << 24 | fp[:, chosen[:, 0]] << 16 | fp[:, chosen[:, 1]] << 8 | fp[:, chosen[:, 2]]
            rows = np.repeat(np.arange(n), len(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("rep").take(pa.array(rows)), pc.binary_slice(batch.column("fp"), 0, carried or fp.shape[1]).take(pa.array(rows))], ["key", "rep", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(last: bool) -> Iterator[pa.RecordBatch]:
            """Links of the postings held; the last posting may go on in the next batch and stays."""
            table = pa.Table.from_batches(held)
            held.clear()
            key = table.column("key").to_numpy()
            cut = len(key) if last else int(np.searchsorted(key, key[-1], "left"))
            if cut < len(key):
                held.extend(table.slice(cut).combine_chunks().to_batches())
            if not cut:
                return
            key, rep = key[:cut], table.column("rep").to_numpy()[:cut]
            fp = np.frombuffer(b"".join(table.column("fp").slice(0, cut).to_pylist()), np.uint64).reshape(cut, -1)
            _, first, sizes = np.unique(key, return_index=True, return_counts=True)
            out_a, out_b, of_forest = [], [], []
            small = np.repeat(sizes <= large, sizes)
            step = 1
            while step < min(int(sizes.max()), large):
                i = np.flatnonzero(small[:-step] & (key[:-step] == key[step:]))
                if not len(i):
                    break
                i = i[linked(fp[i], fp[i + step], max_bits, least_shared)]
                out_a.append(rep[i])
                out_b.append(rep[i + step])
                of_forest.append(np.zeros(len(i), np.int64))
                step += 1
            for at, n in zip(first[sizes > large].tolist(), sizes[sizes > large].tolist(), strict=True):
                if got := _spanning(fp[at : at + n], max_bits, least_shared, steps):
                    i, j = np.array(got).T
                    out_a.append(rep[at + i])
                    out_b.append(rep[at + j])
                    of_forest.append(np.ones(len(i), np.int64))
            a, b, forest = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b, of_forest))
            if len(a):
                ends = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b), *([forest] if tell else []))), axis=1)
                columns = [pa.array(ends[0]), pa.array(ends[1]), *([pa.array(ends[2] > 0)] if tell else [])]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "large"][: len(columns)])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if held[0].column("key")[0] != batch.column("key")[-1]:  # else one posting goes on
                    yield from pairs(False)
        if held:
            yield from pairs(True)

    posted = classes.mapInArrow(post, "key long, rep long, fp binary")
    dealt = posted.repartition("key").sortWithinPartitions("key")
    if tell:
        return dealt.mapInArrow(meet, "a long, b long, large boolean").groupBy("a", "b").agg(F.max("large").alias("large"))
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 4, n_bytes: int = 8, max_bits: int = 4, triples: list[tuple[int, ...]] | None = None) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (the least doc_id reachable by links of at most max_bits bits)."""
    work = Workspace(spark, "simhash")
    triples = covering_triples() if triples is None else triples
    prints = work.write(fingerprints(docs, words, n_bytes), "fingerprints")
    # a class of equal fingerprints is a node by its fingerprint, as rows without a doc_id may be all that it has
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if n_bytes == 8 else F.xxhash64("fp")
    classes = work.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", node), "classes")
    edges = links(classes.select(F.col("node").alias("rep"), "fp"), triples, max_bits, max(3, n_bytes - max_bits))
    roots = components(work, edges)
    named = work.write(classes.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")), "named")
    least = work.write(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    told = work.write(named.join(least, "root").select("fp", "component_id"), "told")
    return prints.join(told, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def shingle_set(text: str, words: int) -> np.ndarray:
    """The different 32-bit fingerprints of a text's shingles, in order."""
    found = _words(text)
    if not found:
        return np.zeros(0, np.uint32)
    k = min(words, len(found))
    digest = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + k])) for i in range(len(found) - k + 1)), np.uint32, len(found) - k + 1))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; two empty ones are equal."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def shingle_sets(keyed: DataFrame, words: int) -> DataFrame:
    """node and shingles for each node; keyed: node, text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in blocks(batches):
            found = [shingle_set(x, words).astype("<u4").tobytes() for x in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])

    return keyed.mapInArrow(sets, "node long, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))


def similar_links(held: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """The candidate pairs whose shingle sets reach the least similarity; held: node, shingles for each node of a pair."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            kept = np.array([similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= least for x, y in pairs], bool)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    x, y = (held.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    return candidates.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def similar_across(x: list[bytes], y: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of sets, one of x and one of y, that reach the least similarity."""
    sets = [np.frombuffer(b, "<u4") for b in y]
    sizes = np.array([len(b) for b in sets], np.int64)
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], np.repeat(np.arange(len(sets)), sizes)[order]
    out_i, out_j = [], []
    for i, b in enumerate(x):
        a = np.frombuffer(b, "<u4")
        low, high = np.searchsorted(items, a, "left"), np.searchsorted(items, a, "right")
        counts = high - low
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - counts), counts)
        shared = np.bincount(owner[at], minlength=len(sets))
        whole = len(a) + sizes - shared
        j = np.flatnonzero(np.where(whole > 0, shared / np.maximum(whole, 1), 1.0) >= least)
        out_i.append(np.full(len(j), i))
        out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def displaced_links(work: Workspace, held: DataFrame, forest: DataFrame, found: DataFrame, least: float, block: int = 512) -> DataFrame:
    """Links that join what verification left apart inside the trees of forest; found: the links verified so far.

    Whatever a large posting holds is one tree of forest.  A link between two verified parts of a tree has an
    end outside the tree's largest part, so the nodes outside are compared with all of the tree, set by set, in
    blocks of about block nodes on a side.
    """
    trees = components(work, forest)
    trees = work.write(trees.union(trees.select(F.col("root").alias("node"), "root").distinct()).toDF("node", "tree"), "trees")
    parts = components(work, found)
    placed = work.write(trees.join(parts, "node", "left").select("node", "tree", F.coalesce("root", "node").alias("part")), "parts")
    sizes = work.write(placed.groupBy("tree", "part").agg(F.count("*").alias("n")), "sizes")
    largest = sizes.groupBy("tree").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("most"))
    blocked = F.ceil(F.col("n") / block).cast("int")
    rest = F.ceil((F.col("n") - F.col("most.n")) / block).cast("int")
    split = work.write(largest.filter("n > most.n").select("tree", F.col("most.part").alias("most"), blocked.alias("n_y"), rest.alias("n_x")), "split")
    # the tree's size says how often a node is sent, so a node of a small tree is sent once
    nodes = placed.join(split, "tree").join(held.hint("merge"), "node")

    def side(nodes: DataFrame, own: str, other: str) -> DataFrame:
        dealt = nodes.withColumn(own, F.pmod(F.xxhash64("node"), F.col(f"n_{own}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        return dealt.select(*(F.col(c).alias(c) for c in ("tree", "x", "y", "node", "shingles"))).groupBy("tree", "x", "y")

    def compare(outside: pa.Table, every: pa.Table) -> pa.Table:
        a, b = outside.column("node").to_numpy(), every.column("node").to_numpy()
        out: list[tuple[int, int]] = []
        if len(a) and len(b):
            names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            joined = _Forest(len(names))
            i, j = similar_across(outside.column("shingles").to_pylist(), every.column("shingles").to_pylist(), least)
            out = [(int(names[u]), int(names[v])) for u, v in zip(at[i].tolist(), at[len(a) + j].tolist(), strict=True) if joined.join(u, v)]
        return pa.table({"a": pa.array([u for u, _ in out], pa.int64()), "b": pa.array([v for _, v in out], pa.int64())})

    return side(nodes.filter("part <> most"), "x", "y").cogroup(side(nodes, "y", "x")).applyInArrow(compare, "a long, b long")


def keep_one(
    spark: SparkSession, docs: DataFrame, words: int = 5, least: float = 0.8, n_bytes: int = 64, carried: int = 16, max_bits: int = 30, postings: int = 256
) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id, with all its columns.

    Documents are linked if their sets of 5-word shingles have a similarity of at least 0.8.  Such sets have SimHashes
    that differ in some 15 % of their bits, 19 of 128, so fingerprints within 30 of the first 128 bits are candidates.
    No number of bytes is shared for certain then: 256 triples of bytes of a fingerprint of 512 bits meet by chance, and
    a test measures how often (``test_recall_by_similarity``: at least 0.9 of the pairs of similarity 0.8 to 0.85, 0.97 at
    0.85 to 0.9 and 0.99 above).  Candidates are verified on the sets, and so fingerprints are those of the sets, in which a
    repeated shingle counts once.  In postings of more than 16 texts a forest of close candidates is verified first; what
    stays apart in it is then compared set by set with all that the forest spans, so no link is lost by the choice of
    the forest.

    Texts of the same words are one node.  Rows without a doc_id stay.  Rows with one doc_id and text become one.
    """
    work = Workspace(spark, "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in blocks(batches):
            texts = rows.column("text").to_pylist()
            nodes, checks = (np.array([xxhash.xxh64_intdigest(b" ".join(_words(x)), seed) for x in texts], np.uint64).view(np.int64) for seed in (0, 1))
            fps = [simhash(x, words, n_bytes, distinct=True) for x in texts]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), pa.array(nodes), pa.array(checks), pa.array(fps, pa.binary())], ["doc_id", "tie", "node", "check", "fp"])

    # a row is known by its doc_id and a fingerprint of its text, a text's words by two fingerprints
    keyed = texts_of(docs).filter("doc_id is not null").withColumn("tie", F.xxhash64("text"))
    prints = work.write(keyed.mapInArrow(run, "doc_id long, tie long, node long, check long, fp binary"), "fingerprints")
    prints, classes = _apart(work, prints)
    found = work.write(links(classes.select(F.col("node").alias("rep"), "fp"), spread_triples(n_bytes, postings), max_bits, 0, steps=4, tell=True, carried=carried), "candidates")
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(classes, "node").select("node", F.col("least").alias("text_doc"), F.col("tie").alias("text_tie"))
    # merge joins at every size: texts are dealt by their row once, and what they meet grows with the corpus
    chosen = keyed.join(ends.hint("merge"), (F.col("doc_id") == F.col("text_doc")) & (F.col("tie") == F.col("text_tie"))).select("node", "text")
    held = work.write(shingle_sets(chosen, words), "shingles")
    linked_pairs = work.write(similar_links(held, found.select("a", "b"), least), "links")
    more = work.write(displaced_links(work, held, found.filter("large").select("a", "b"), linked_pairs, least), "displaced")
    roots = components(work, linked_pairs.union(more))
    of_root = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of_root = work.write(of_root, "roots")
    first = work.write(of_root.groupBy("root").agg(F.min("least").alias("first")), "first")
    named = work.write(of_root.join(first, "root").select("node", "first"), "named")
    others = work.write(prints.join(named, "node").filter("doc_id <> first").select(F.col("doc_id").alias("copy_doc"), F.col("tie").alias("copy_tie")).distinct(), "others")
    whole = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("document_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("document_tie"))
    of = lambda a: (F.col("document_doc") == F.col(f"{a}_doc")) & (F.col("document_tie") == F.col(f"{a}_tie"))
    kept = whole.join(others.hint("merge"), of("copy"), "left_anti")
    repeated = work.write(prints.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("repeated_doc"), F.col("tie").alias("repeated_tie")), "repeated")
    if not repeated.isEmpty():  # of rows that are there more than once one stays, the same one in every run
        first_of = Window.partitionBy("document_doc", "document_tie").orderBy(F.xxhash64(F.to_json("document")))
        once = kept.join(repeated, of("repeated"), "left_semi").withColumn("rank", F.row_number().over(first_of)).filter("rank = 1")
        kept = kept.join(repeated, of("repeated"), "left_anti").select("document").union(once.select("document"))
    return kept.select(*(F.col(f"document.`{c}`").alias(c) for c in docs.columns))


def _apart(work: Workspace, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prints, and its classes of equal words (node, fp, least doc_id and its tie); different words with one node get nodes of their own."""
    once = prints.groupBy("node", "check").agg(F.min(F.struct("doc_id", "tie")).alias("of"), F.min("fp").alias("fp"))
    classes = work.write(once.select("node", "check", "fp", F.col("of.doc_id").alias("least"), F.col("of.tie").alias("tie")), "classes")
    clash = work.write(classes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("node").alias("clash")), "clashes")
    if clash.isEmpty():
        return prints, classes
    own = F.when(F.col("clash").isNull(), F.col("node")).otherwise(F.xxhash64("node", "check"))
    told = lambda rows: rows.join(clash, F.col("node") == F.col("clash"), "left").withColumn("node", own).drop("clash")
    return told(prints), told(classes)
