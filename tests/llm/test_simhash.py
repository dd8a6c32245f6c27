"""SimHash near-duplicates and connected components against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidepool.llm import simhash_dedup
from tidepool.llm.common import Workspace
from tidepool.llm.components import components

from . import cases


def fingerprint(text):
    words = cases.WORD.findall((text or "").translate(cases.LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_against_brute_force(spark):
    made = cases.rows()
    made += [(None, "no other text is like this one without an id", "en", "s", 0)]
    fps = [(r[0], fingerprint(r[1])) for r in made]
    names = sorted({x for _, x in fps}, key=lambda x: min((d for d, y in fps if y == x and d is not None), default=10**9))  # by least doc_id
    links = [(a, b) for (a, x), (b, y) in combinations(enumerate(names), 2) if (x ^ y).bit_count() <= 4]
    first = roots(range(len(names)), links)
    least = lambda x: min((d for d, y in fps if d is not None and first[names.index(y)] == first[names.index(x)]), default=None)
    got = simhash_dedup.near_duplicates(spark, cases.clashing(cases.documents(spark, made))).collect()
    assert Counter(map(tuple, got)) == Counter((d, f"{x:016x}", least(x)) for d, x in fps)
    assert simhash_dedup.near_duplicates(spark, cases.documents(spark, [])).count() == 0


def test_every_four_positions_contain_a_triple():
    triples = [set(t) for t in simhash_dedup.covering_triples()]
    assert len(triples) == 20 and all(any(t <= set(c) for t in triples) for c in combinations(range(8), 4))


def test_large_postings_lose_no_link(spark):
    """Hundreds of fingerprints in a few Hamming balls that share postings."""
    rng = np.random.default_rng(8)
    made = set()
    for centre in rng.integers(0, 1 << 62, 3).tolist():
        for _ in range(150):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 9)).tolist():
                x ^= 1 << b
            made.add(x)
    fps = sorted(made)
    classes = spark.createDataFrame([(i, bytearray(x.to_bytes(8, "big"))) for i, x in enumerate(fps)], "rep long, fp binary")
    found = [(r.a, r.b) for r in simhash_dedup.links(classes, simhash_dedup.covering_triples(), 4, 4).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in found)
    want = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert roots(range(len(fps)), found) == roots(range(len(fps)), want)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7)]
    edges = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(Workspace(spark, "test"), edges).collect()}
    root = roots({n for e in links for n in e}, links)
    assert got == {n: r for n, r in root.items() if n != r}
    assert components(Workspace(spark, "test"), edges.filter(F.lit(False))).count() == 0


def test_one_of_each_group_stays(spark):
    made = cases.rows()
    docs = cases.clashing(cases.documents(spark, made))
    kept = simhash_dedup.keep_one(spark, docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # 5 has copies 6, 7 and near copies 11 to 18; the row without an id stays
    assert 5 in ids and not {6, 7, *range(11, 19)} & set(ids) and None in ids and ids.count(5) == 1
    assert {8, 9, 10, 19, 20} <= set(ids)


def test_near_copies_of_one_text_all_go(spark):
    """A base and 1000 variants that are similar to it (0.84) and not to each other (0.73)."""
    base = [f"w{k}" for k in range(300)]
    made = [(0, " ".join(base), "en", "s", 0)]
    for v in range(1, 1001):
        words = list(base)
        for k in range(5):
            words[(v * 7) % 55 + 60 * k] = f"v{v}x{k}"
        made.append((v, " ".join(words), "en", "s", 0))
    assert [r.doc_id for r in simhash_dedup.keep_one(spark, cases.documents(spark, made)).select("doc_id").collect()] == [0]


def test_sets_across():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 12, n).astype("<u4")) for n in (0, 0, *range(1, 40))]
    packed = [s.tobytes() for s in sets]
    i, j = simhash_dedup.similar_across(packed[:20], packed, 0.8)
    want = {(i, j) for i in range(20) for j in range(len(sets)) if simhash_dedup.similarity(sets[i], sets[j]) >= 0.8}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_repeated_lines_do_not_part_equal_sets(spark):
    text, line = " ".join(f"w{k}" for k in range(300)), " ".join(f"r{k}" for k in range(12))
    made = [(k, "\n".join([text, *[line] * n]), "en", "s", 0) for k, n in enumerate((2, 10, 30, 100))]
    assert len({simhash_dedup.simhash(r[1], 5, 16, distinct=True) for r in made}) == 1
    assert [r.doc_id for r in simhash_dedup.keep_one(spark, cases.documents(spark, made)).select("doc_id").collect()] == [0]


def test_recall_by_similarity(spark):
    """Pairs whose sets of shingles are of a known similarity: which share of each band loses its copy."""
    rng = np.random.default_rng(12)
    made, band = [], {}
    for k in range(240):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 260)]
        copy = list(words)
        for at in rng.choice(50, int(rng.integers(1, 7)), replace=False).tolist():
            copy[5 * at + 2] = f"c{k}x{at}"
        a, b = (simhash_dedup.shingle_set(" ".join(x), 5) for x in (words, copy))
        similar = simhash_dedup.similarity(a, b)
        if similar >= 0.8:
            band[2 * k + 1] = min(int((similar - 0.8) / 0.05), 2)
        made += [(2 * k, " ".join(words), "en", "s", 0), (2 * k + 1, " ".join(copy), "en", "s", 0)]
    kept = {r.doc_id for r in simhash_dedup.keep_one(spark, cases.documents(spark, made)).select("doc_id").collect()}
    assert {2 * k for k in range(240)} <= kept and all(d in kept for d in range(1, 480, 2) if d not in band)
    for low, least in ((0, 0.9), (1, 0.97), (2, 0.99)):
        found = [d not in kept for d, b in band.items() if b == low]
        assert len(found) > 20 and np.mean(found) >= least


def test_different_words_of_one_fingerprint_stay_apart(spark):
    rows = [(1, 10, 5, 7, b"a"), (2, 20, 5, 8, b"b"), (3, 30, 6, 9, b"c"), (4, 40, 5, 7, b"a")]
    prints = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "doc_id long, tie long, node long, check long, fp binary")
    told, classes = simhash_dedup._apart(Workspace(spark, "test"), prints)
    node = {r.doc_id: r.node for r in told.collect()}
    assert node[1] == node[4] != node[2] and len(set(node.values())) == 3 and node[3] == 6
    assert {(r.node, r.least, r.tie) for r in classes.collect()} == {(node[1], 1, 10), (node[2], 2, 20), (6, 3, 30)}


def test_of_repeated_rows_the_same_one_stays(spark):
    made = [(1, "a b c", lang, "s", 0) for lang in ("en", "de", "fr")]
    kept = {tuple(r) for parts in (1, 2, 3) for r in simhash_dedup.keep_one(spark, spark.createDataFrame(made, cases.SCHEMA).repartition(parts)).collect()}
    assert len(kept) == 1
