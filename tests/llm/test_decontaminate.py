"""Benchmark decontamination against brute-force edit distances."""

import random

import numpy as np
import pytest

from tidepool.llm import decontaminate
from tidepool.llm.decontaminate import find_items, fitting_distance, index_items

from . import cases
from ..conftest import SF

ITEMS = "item_id long, text string"


def edited(words, k, rng):
    w = list(words)
    for _ in range(k):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        w[at : at + (kind < 2)] = [f"new{rng.randrange(10**6)}"] if kind else []
    return w


def test_recall_and_exactness(spark):
    items = cases.sample("benchmark", SF)
    rng = random.Random(5)
    prose = [w for t in cases.sample("documents", SF, 30)["text"] for w in (t or "").split()][:6000]
    made, want = [], {}
    for k, (i, t) in enumerate(zip(items["item_id"], items["text"], strict=True)):
        words = t.split()
        for share in (0, 0.1, 0.2):
            doc = len(made)
            at = rng.randrange(5000)
            made.append((doc, " ".join(prose[at : at + 40] + edited(words, int(share * len(words)), rng) + prose[at + 40 : at + 90]), "en", "s", 0))
            want[doc] = i
    for k in range(60):
        made.append((len(made), " ".join(rng.choice(prose) for _ in range(200)), "en", "s", 0))
    got = find_items(spark, cases.documents(spark, made), spark.createDataFrame(list(zip(items["item_id"], items["text"], strict=True)), ITEMS)).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert sum((d, i) in found for d, i in want.items()) >= 0.97 * len(want)
    assert all(r.distance <= 0.2 * r.item_words for r in got)
    assert all(r.doc_id in want for r in got)


def naive(item, region):
    best = len(item)
    for a in range(len(region) + 1):
        row = list(range(len(item) + 1))
        best = min(best, row[-1])
        for y in region[a:]:
            last, row[0] = row[0], row[0] + 1
            for i, x in enumerate(item, 1):
                last, row[i] = row[i], min(last + (x != y), row[i] + 1, row[i - 1] + 1)
            best = min(best, row[-1])
    return best


def test_fitting_distance():
    rng = random.Random(9)
    for _ in range(200):
        item, region = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (7, 12))
        d, a, n = fitting_distance(item, region)
        assert d == naive(item, region)
        assert naive(item, region[a : a + n]) == d


def test_short_items_and_odd_tables(spark):
    docs = cases.clashing(cases.documents(spark, [*cases.rows(), (700, "say: \"Hello, World again\"!", "en", "s", 0), (701, "hello world", "en", "s", 0)]))
    items = spark.createDataFrame([(1, "hello world AGAIN"), (2, None), (3, ""), (4, "..."), (None, "x"), (5, "one"), (1, "hello world AGAIN")], ITEMS)
    got = {(r.doc_id, r.item_id, r.distance) for r in find_items(spark, docs, items).collect()}
    assert {(700, 1, 0), (3, 5, 0)} <= got and not any(d == 701 for d, _, _ in got)
    assert find_items(spark, docs, items.limit(0)).count() == 0
    assert find_items(spark, cases.documents(spark, []), items).count() == 0
    clean = decontaminate.keep_clean(spark, docs, items)
    assert clean.schema == docs.schema and not {700, 3} & {r.doc_id for r in clean.collect()}


def test_blocks_of_items_give_the_same(spark):
    items = cases.sample("benchmark", SF)
    bench = spark.createDataFrame(list(zip(items["item_id"], items["text"], strict=True)), ITEMS)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = ({tuple(r) for r in find_items(spark, docs, bench, block_bytes=b).collect()} for b in (1 << 24, 4000))
    assert one and one == many


def test_embedding_keeps_equal_windows_equal():
    words = np.arange(1, 21, dtype=np.uint64).reshape(2, 10)
    e = decontaminate.embed(words, 0)
    assert e.shape == (2, 30) and (e[0] != e[1]).any() and (decontaminate.embed(words[:1], 0) == e[:1]).all()


def test_batch_verification_against_the_plain_distance():
    rng = np.random.default_rng(6)
    item, region = rng.integers(1, 5, (300, 6)).astype(np.uint64), rng.integers(1, 5, (300, 9)).astype(np.uint64)
    for k in (0, 1, 2, 3):
        got = decontaminate.within(item, region, k)
        assert got.tolist() == [naive(i, r) <= k for i, r in zip(item.tolist(), region.tolist(), strict=True)]


def test_walks_reach_their_recall_or_say_so():
    assert decontaminate.walks_for(30, 0, 0.99) == 1
    assert decontaminate.walks_for(30, 6, 0.99) <= 64
    with pytest.raises(ValueError):
        decontaminate.walks_for(60, 12, 0.99, most=1)


def test_long_items_beside_short_ones_and_stock_phrases(monkeypatch):
    """A long item does not change what is found of short ones, and a seed of all items in all texts is worked on in parts."""
    rng = random.Random(3)
    stock = "which of the following"
    short = [(i, f"{stock} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(20))}") for i in range(300)]
    long = (999, " ".join(f"v{rng.randrange(10**6)}" for _ in range(1500)))
    texts = [f"{stock} a b c {short[i][1]} d e f {stock}".encode() for i in range(0, 300, 7)] + [f"x y {long[1]} z".encode(), b""]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    monkeypatch.setattr(decontaminate, "PART", 1000)
    alone, both = (decontaminate.found_in_block(index_items(block, 0.2, 0.99), data, at) for block in (short, [*short, long]))
    assert {(r, i) for r, i, *_ in alone} == {(k, i) for k, i in enumerate(range(0, 300, 7))}
    assert [x for x in both if x[1] != 999] == alone and [(x[0], x[4]) for x in both if x[1] == 999] == [(len(texts) - 2, 0)]


def test_whole_tables_against_brute_force(spark):
    """Every document of the smallest sample with every item, by the edit distance of all stretches."""
    items = cases.sample("benchmark", SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.createDataFrame(list(zip(items["item_id"], items["text"], strict=True)), ITEMS)
    got = {(r.doc_id, r.item_id): r.distance for r in find_items(spark, docs, bench).collect()}

    def read(texts):
        held = [(t or "").encode() for t in texts]
        units, places = decontaminate.normalised(np.frombuffer(b"".join(held), np.uint8), np.append(0, np.cumsum([len(t) for t in held])).astype(np.int64))
        return [units[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]

    want = {}
    table = cases.sample("documents", SF)
    for d, text in zip(table["doc_id"], read(table["text"]), strict=True):
        for i, item in zip(items["item_id"], read(items["text"]), strict=True):
            k = int(0.2 * len(item))
            row, step = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
            for x in item:
                now = row + 1
                now[1:] = np.minimum(now[1:], row[:-1] + (text != x))
                row = np.minimum.accumulate(now - step) + step
            if len(item) and row.min() <= k:
                want[d, i] = int(row.min())
    assert len(want) > 0 and set(got) <= set(want) and all(got[x] == want[x] for x in got)
    assert len(got) >= 0.99 * len(want)
