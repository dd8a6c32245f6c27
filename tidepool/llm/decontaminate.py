"""Benchmark decontamination by edit distance.

An item is found in a text where some stretch of words is within ``floor(max_share * words)`` word edits of it.

* Seeds: k edits leave one run of at least ``(n - k) / (k + 1)`` of an item's n words untouched, so only
  item-sized windows that share such a run (3 words at most) in place with an item can hold it.  Looking the
  runs up loses nothing.
* CGK embedding: a random walk over a window's words, which advances or stays by a random bit of the word,
  writes ``3 n`` symbols.  Windows at small edit distance get embeddings at small Hamming distance.
* Bit-sampling LSH: each of several walks is sampled at a few places, and windows whose samples equal an
  item's are candidates.  The number of walks is what reaches ``recall`` in trials with as many edits as allowed,
  in which the search runs on random words; it depends on an item's number of words alone.  Where no number
  reaches it, an error says so.
* Verification: the exact edit distance between the item and the best stretch around the window, for many
  windows at once.

Words are lower-cased (A-Z) and stripped of ASCII punctuation at both ends; they are compared by 64-bit
fingerprints.  The index is as large as the items, which are kept by number of words, so that a long item costs
others nothing; matrices and expanded seed hits are cut into parts of bounded size.  Items are read in blocks of
at most ``block_bytes`` bytes of text, each block being a pass over the documents, so what is sent to executors
is bounded.  What is found does not depend on the blocks.

Defined cases: null, empty and wordless items find nothing; null and empty texts hold nothing.  Items with one
item_id are one item with several wordings.  Rows without a doc_id are scanned and reported with a null.
Repeated rows are reported each.  Empty tables give an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, RollingHash, _mixed, blocks, spread, texts_of, word_spans, word_units

HITS = "doc_id long, item_id long, start_word long, n_words long, distance long, item_words long"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_PAD = U64(0)
SEED = 3
#: Sampled sets of each walk and places of each set.
SETS, WIDTH = 8, 4
#: Matrix cells that are worked on at once, seed hits that are expanded at once, and words of an item in trials at most.
CELLS, PART, TRIAL_WORDS = 1 << 21, 1 << 17, 128


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of a block, and at which word each row starts."""
    data = _LOWER[data]
    starts, ends, places = word_spans(data, at)
    if not len(starts):
        return np.zeros(0, U64), places
    marks = np.append(0, np.cumsum(_MARK[data]))
    inner = marks[ends] - marks[starts] < ends - starts  # words of punctuation alone stay as they are
    todo = inner.copy()
    while todo.any():
        todo &= _MARK[data[ends - 1]]
        ends = ends - todo
    todo = inner.copy()
    while todo.any():
        todo &= _MARK[data[starts]]
        starts = starts + todo
    return word_units(data, starts, ends), places


def embed(words: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings of rows of n words each: 3 n symbols, padded where a walk ends early."""
    rows, n = words.shape
    padded = np.concatenate((words, np.full((rows, 1), _PAD)), axis=1)
    out = np.empty((rows, 3 * n), U64)
    place = np.zeros(rows, np.int64)
    row = np.arange(rows)
    for step in range(3 * n):
        symbol = padded[row, place]
        out[:, step] = symbol
        bit = _mixed(symbol + U64((walk * 1_000_003 + step) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & U64(1)
        place = np.minimum(place + bit.astype(np.int64), n)
    return out


@functools.lru_cache(4096)
def _samples(n: int, walk: int, sets: int, width: int) -> np.ndarray:
    """The places at which embeddings of n words are sampled in one walk."""
    return np.random.default_rng(1000 * walk + n).integers(0, 3 * n, (sets, width))


def keys(words: np.ndarray, walk: int, sets: int = SETS, width: int = WIDTH) -> np.ndarray:
    """One key for each row of words and each sampled set of one walk, part by part of bounded cells."""
    rows, n = words.shape
    places = _samples(n, walk, sets, width)
    out = np.empty((rows, sets), U64)
    step = max(1, CELLS // (3 * n))
    for a in range(0, rows, step):
        e = embed(words[a : a + step], walk)
        for s in range(sets):
            x = np.full(len(e), s + 1, U64)
            for at in places[s].tolist():
                x = _mixed(x * U64(0x9E3779B97F4A7C15) + e[:, at])
            out[a : a + step, s] = x
    return out


def seed_size(n: int, k: int) -> int:
    """Words of a run that k edits leave untouched somewhere among n words, 3 at most."""
    return min(SEED, -(-(n - k) // (k + 1)))


def _edited(words: list[int], k: int, rng: np.random.Generator) -> list[int]:
    """words after k edits of random kind and place; new words are unlike all others."""
    out = list(words)
    for _ in range(k):
        at, kind = int(rng.integers(0, len(out) + 1)), int(rng.integers(0, 3))
        out[at : at + (kind < 2)] = [int(rng.integers(1, 1 << 62))] if kind else []
    return out


@functools.lru_cache(4096)
def walks_for(n: int, k: int, recall: float, most: int = 64, trials: int = 200) -> int:
    """Walks until the stated share of items of n words, edited k times and put into a text, meets its item.

    Trials are the search itself on random words: windows lie where seeds put them, edits before a seed shift them.
    The number depends on n and k alone, so it is the same whatever other items are searched for.  Items of more
    than 128 words take the number for 128 and as large a share of edits.
    """
    if n > TRIAL_WORDS:
        return walks_for(TRIAL_WORDS, k * TRIAL_WORDS // n, recall, most, trials)
    if not k:
        return 1
    rng = np.random.default_rng(1009 * n + k)
    size = seed_size(n, k)
    items, windows, owner = [], [], []
    for t in range(trials):
        item = rng.integers(1, 1 << 62, n).tolist()
        text = rng.integers(1, 1 << 62, n).tolist() + _edited(item, k, rng) + rng.integers(1, 1 << 62, n).tolist()
        runs = {tuple(item[o : o + size]): o for o in range(n - size + 1)}
        starts = {p - runs[r] for p in range(len(text) - size + 1) if (r := tuple(text[p : p + size])) in runs}
        items.append(item)
        windows += [text[s : s + n] for s in sorted(starts) if 0 <= s <= len(text) - n]
        owner += [t] * (len(windows) - len(owner))
    held, seen, own = np.array(items, U64), np.array(windows, U64).reshape(-1, n), np.array(owner, np.int64)
    met = np.zeros(trials, bool)
    for walk in range(most):
        same = (keys(seen, walk) == keys(held, walk)[own]).any(axis=1)
        met[own[same]] = True
        if met.mean() >= recall:
            return walk + 1
    raise ValueError(f"{most} walks do not reach a recall of {recall} for {n} words and {k} edits")


def within(item: np.ndarray, regions: np.ndarray, k: int) -> np.ndarray:
    """For rows of item words and of regions: whether some stretch of the region is within k edits of the item."""
    rows, m = regions.shape
    step = np.arange(m + 1)
    row = np.zeros((rows, m + 1), np.int64)
    for i in range(item.shape[1]):
        now = row + 1  # the item's word is missing
        now[:, 1:] = np.minimum(now[:, 1:], row[:, :-1] + (regions != item[:, i : i + 1]))
        row = np.minimum.accumulate(now - step, axis=1) + step  # words of the region between
    return row.min(axis=1) <= k


def fitting_distance(item: list[int], region: list[int]) -> tuple[int, int, int]:
    """Least edit distance between the item and any stretch of the region, with that stretch's start and words."""
    row, begin = [0] * (len(region) + 1), list(range(len(region) + 1))
    for i, x in enumerate(item, 1):
        last_d, last_b = row[0], begin[0]
        row[0] = i
        for j, y in enumerate(region, 1):
            best, b = last_d + (x != y), last_b
            last_d, last_b = row[j], begin[j]
            if last_d + 1 < best:
                best, b = last_d + 1, last_b
            if row[j - 1] + 1 < best:
                best, b = row[j - 1] + 1, begin[j - 1]
            row[j], begin[j] = best, b
    end = min(range(len(row)), key=lambda j: (row[j], j))
    return row[end], begin[end], end - begin[end]


@dataclass
class Length:
    """The items of one number of words: their words as rows, their seeds in order, and their keys in each walk."""

    ids: np.ndarray
    words: np.ndarray
    edits: int
    recall: float

    def __post_init__(self) -> None:
        rows, n = self.words.shape
        self.seed = seed_size(n, self.edits)
        runs = n - self.seed + 1
        value = np.stack([RollingHash(w).windows(self.seed) for w in self.words]).ravel()
        order = np.argsort(value, kind="stable")
        self.value, self.item, self.offset = value[order], (order // runs).astype(np.int32), (order % runs).astype(np.int32)
        self.keys = [keys(self.words, walk) for walk in range(walks_for(n, self.edits, self.recall))]

    def seeded(self, hit: np.ndarray, prints: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, start and item of the windows that share a seed in place with an item, in parts of bounded size; hit and
        prints: places of seeds, of these or other items, and their fingerprints."""
        low = np.searchsorted(self.value, prints, "left")
        count = np.searchsorted(self.value, prints, "right") - low
        own = np.flatnonzero(count)
        hit, low, count = hit[own], low[own], count[own]
        pieces = -(-count // PART)  # a seed that very many items have is taken in parts as well
        piece = spread(np.zeros(len(hit), np.int64), pieces)
        hit, low, count = (np.repeat(x, pieces) for x in (hit, low, count))
        low, count = low + piece * PART, np.minimum(count - piece * PART, PART)
        n, wide = self.words.shape[1], int(places[-1]) + 2 * self.words.shape[1]
        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(count) // PART)) + 1) if len(hit) else []:
            k = spread(low[part], count[part])
            at = np.repeat(hit[part], count[part])
            row = np.searchsorted(places, at, "right") - 1
            once = np.unique((row * len(self.ids) + self.item[k]) * wide + at - self.offset[k] + n)
            yield once // wide // len(self.ids), once % wide - n, once // wide % len(self.ids)

    def _words_at(self, units: np.ndarray, places: np.ndarray, row: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        """size words from each start; beyond the row is padding."""
        index = start[:, None] + np.arange(size)
        inside = (index >= places[row][:, None]) & (index < places[row + 1][:, None])
        return np.where(inside, units[np.clip(index, 0, len(units) - 1)], _PAD)

    def candidates(self, units: np.ndarray, places: np.ndarray, hit: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, start and item of windows that have a seed and a key of some walk in common with the item.

        Each word of the item that the window and its surroundings lack costs an edit, so windows that lack too many
        are spared the walks."""
        n, k = self.words.shape[1], self.edits
        for row, start, item in self.seeded(hit, prints, places):
            step = max(1, CELLS // (n * (n + 2 * k)))
            kept = []
            for a in range(0, len(row), step):
                region = self._words_at(units, places, row[a : a + step], start[a : a + step] - k, n + 2 * k)
                there = (self.words[item[a : a + step]][:, :, None] == region[:, None, :]).any(axis=2).sum(axis=1)
                kept.append(a + np.flatnonzero(there >= n - k))
            kept = np.concatenate(kept)
            row, start, item = row[kept], start[kept], item[kept]
            met = np.zeros(len(row), bool)
            for walk, theirs in enumerate(self.keys):
                rest = np.flatnonzero(~met)
                for a in range(0, len(rest), step):
                    r = rest[a : a + step]
                    mine = keys(self._words_at(units, places, row[r], start[r], n), walk)
                    met[r] = (mine == theirs[item[r]]).any(axis=1)
            yield row[met], start[met], item[met]

    def found(self, units: np.ndarray, places: np.ndarray, hit: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item_id, start_word, n_words, distance, item_words) of each candidate that holds its item."""
        n, k = self.words.shape[1], self.edits
        for row, start, item in self.candidates(units, places, hit, prints):
            step = max(1, CELLS // (n + 2 * k + 1))
            for a in range(0, len(row), step):
                r, s, i = row[a : a + step], start[a : a + step], item[a : a + step]
                near = np.flatnonzero(within(self.words[i], self._words_at(units, places, r, s - k, n + 2 * k), k))
                for x in near.tolist():
                    first, last = int(places[r[x]]), int(places[r[x] + 1])
                    a0, b0 = max(first, int(s[x]) - k), min(last, int(s[x]) + n + k)
                    distance, begin, size = fitting_distance(self.words[i[x]].tolist(), units[a0:b0].tolist())
                    if distance <= k:  # padding may stand for words that are not there
                        yield int(r[x]), int(self.ids[i[x]]), a0 + begin - first, size, distance, n


class Items:
    """The index over a block of items, by number of words.  What is found for an item does not depend on the others."""

    def __init__(self, ids: list[int], words: list[np.ndarray], max_share: float, recall: float):
        sizes = np.array([len(w) for w in words])
        self.lengths = []
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            step = max(1, CELLS // n)
            for a in range(0, len(own), step):
                part = own[a : a + step].tolist()
                self.lengths.append(Length(np.array([ids[k] for k in part]), np.stack([words[k] for k in part]), int(max_share * n), recall))
        #: All seeds by their size, so that a text is looked up once and not once for each number of words.
        self.seeds = {m: np.unique(np.concatenate([x.value for x in self.lengths if x.seed == m])) for m in {x.seed for x in self.lengths}}

    def hits(self, units: np.ndarray, places: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each size of seeds the places in a row at which one stands, and their fingerprints."""
        out, hashes = {}, RollingHash(units)
        for size, values in self.seeds.items():
            prints = hashes.windows(size)
            at = np.searchsorted(values, prints)
            hit = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == prints)
            hit = hit[hit + size <= places[np.searchsorted(places, hit, "right")]]
            out[size] = hit, prints[hit]
        return out


def read_items(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most block_bytes bytes of text (an item longer than that is its own block)."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct().orderBy("item_id", "text").toLocalIterator():
        if held and size + len(r.text) * 4 > block_bytes:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text) * 4
    if held:
        yield held


def index_items(block: list[tuple[int, str]], max_share: float, recall: float) -> Items | None:
    texts = [t.encode() for _, t in block]
    data = np.frombuffer(b"".join(texts), np.uint8)
    units, places = normalised(data, np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64))
    rows = [(i, units[a:b]) for (i, _), a, b in zip(block, places[:-1].tolist(), places[1:].tolist(), strict=True) if b > a]
    return Items([i for i, _ in rows], [w for _, w in rows], max_share, recall) if rows else None


def found_in_block(items: Items, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item_id, start_word, n_words, distance, item_words) for each row of a block and each item in it, verified."""
    units, places = normalised(data, at)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    hits = items.hits(units, places)
    for length in items.lengths:
        for row, item, start, size, distance, n in length.found(units, places, *hits[length.seed]):
            spot = (distance, start, size, n)
            best[row, item] = min(best.get((row, item), spot), spot)
    return [(r, i, s, n, d, m) for (r, i), (d, s, n, m) in sorted(best.items())]


def indexes(benchmark: DataFrame, max_share: float, recall: float, block_bytes: int) -> Iterator[Items]:
    for block in read_items(benchmark, block_bytes):
        if (items := index_items(block, max_share, recall)) is not None:
            yield items


def find_items(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, max_share: float = 0.2, recall: float = 0.99, block_bytes: int = 16 << 20) -> DataFrame:
    """One row for each document and each item found in it: doc_id, item_id, start_word, n_words and distance of its
    best stretch (least distance, then first), and item_words."""
    out = None
    for items in indexes(benchmark, max_share, recall, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, data, at in blocks(batches):
                if hits := found_in_block(shared.value, data, at):
                    row, *rest = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), *(pa.array(c, pa.int64()) for c in rest)], [x.split()[0] for x in HITS.split(", ")])

        hits = texts_of(docs).mapInArrow(run, HITS)
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], HITS) if out is None else out


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, max_share: float = 0.2, recall: float = 0.99, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    for items in indexes(benchmark, max_share, recall, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, data, at in blocks(batches):
                clean = np.ones(rows.num_rows, bool)
                clean[[h[0] for h in found_in_block(shared.value, data, at)]] = False
                yield rows.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
