"""Substring dedup of words and of bytes against brute force."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import queries, repeats, substring_dedup, suffix_dedup
from tidepool.llm.common import Workspace

from . import cases
from ..conftest import SF


def words_expected(made):
    seqs = [(r[0], cases.WORD.findall(r[1] or "")) for r in made]
    for (d, x), m in zip(seqs, cases.covered(seqs, 13), strict=True):
        yield d, len(x), int(m.sum()), " ".join(w for w, gone in zip(x, m, strict=True) if not gone)


def bytes_expected(made):
    seqs = [(r[0], (r[1] or "").encode()) for r in made]
    for (d, x), m in zip(seqs, cases.covered(seqs, 50), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], m.astype(int), [0])))).reshape(-1, 2)
        yield d, len(x), int(m.sum()), tuple((a, b - a) for a, b in edges.tolist()), np.frombuffer(x, np.uint8)[~m].tobytes()


def told(rows):
    return Counter(tuple(tuple(map(tuple, c)) if isinstance(c, list) else bytes(c) if isinstance(c, bytearray) else c for c in r) for r in rows)


@pytest.mark.parametrize(
    "op,expected,options",
    [
        (substring_dedup.drop_repeated_words, words_expected, {}),
        (substring_dedup.drop_repeated_words, words_expected, {"seed": 5, "shard_bytes": 3000}),
        (suffix_dedup.drop_repeated_bytes, bytes_expected, {}),
        (suffix_dedup.drop_repeated_bytes, bytes_expected, {"shard_bytes": 2000}),
    ],
)
def test_against_brute_force(spark, op, expected, options):
    made = cases.rows()
    got = told(op(spark, cases.clashing(cases.documents(spark, made)), **options).collect())
    assert got == Counter(expected(made))


@pytest.mark.parametrize("op", [substring_dedup.drop_repeated_words, suffix_dedup.drop_repeated_bytes])
def test_empty_table(spark, op):
    assert op(spark, cases.documents(spark, [])).count() == 0


@pytest.mark.parametrize("op", [substring_dedup.drop_repeated_words, suffix_dedup.drop_repeated_bytes])
def test_texts_longer_than_a_chunk(spark, op, monkeypatch):
    """The same passages are found in texts of over a megabyte, wherever chunks begin, with one word of 2 MB between."""
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(map(str, rng.integers(10**6, 10**7, n).tolist()))
    passage = say(400)
    long = f"{say(140_000)} {passage} {'y' * (2 << 20)} {say(140_000)}"
    made = [(1, f"{say(50)} {passage}", "en", "s", 0), (2, long, "en", "s", 0), (3, f"{long} {say(9)}", "en", "s", 0)]
    got = {r.doc_id: r for r in op(spark, cases.documents(spark, made)).collect()}
    size = (lambda x: len(x.split())) if op is substring_dedup.drop_repeated_words else len
    extra = 0 if op is substring_dedup.drop_repeated_words else 1  # the blank before the passage
    assert got[1].n_removed == 0 and got[2].n_removed in (size(passage), size(passage) + extra) and got[3].n_removed >= size(long)


def test_hot_passage_of_many_documents(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    made = [(i, f"a{i} b{i} {passage} c{i}", "en", "s", 0) for i in range(300)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeated_words(spark, cases.documents(spark, made)).collect()}
    assert got == {0: 0} | {i: 40 for i in range(1, 300)}


def test_heavy_seeds_are_opened_without_a_loss(spark, monkeypatch):
    """A string that all documents hold in other surroundings: every seed is taken for heavy, and nothing changes."""
    made = [(i, f"{i * 7919} a string that all of the documents hold somewhere {i * 104729} " * (1 + i % 3), "en", "s", 0) for i in range(200)]
    made += [(200 + i, made[i][1] + " more", "en", "s", 0) for i in range(20)]
    want = Counter(bytes_expected(made))
    seen = []

    def every(docs, size, seed, most_runs):
        seen.append(True)
        runs = [repeats.seeded_runs(lambda k, d=np.frombuffer(r[1].encode(), np.uint8): suffix_dedup.byte_units(d[k]), np.array([0, len(r[1].encode())]), size, seed) for r in made]
        return np.unique(np.concatenate([r.seed for r in runs]))[::2]

    monkeypatch.setattr(suffix_dedup, "heavy_seeds", every)
    got = told(suffix_dedup.drop_repeated_bytes(spark, cases.documents(spark, made), shard_bytes=4000).collect())
    assert seen and got == want


def test_heavy_seeds_by_a_sample(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    made = [(i, f"{'%030d' % (i * 7919)} a string that all of the documents hold {'%030d' % (i * 104729)}", "en", "s", 0) for i in range(100)]
    docs = repeats.keyed(cases.documents(spark, made))
    assert len(suffix_dedup.heavy_seeds(docs, 50, 12, 90)) >= 1 and len(suffix_dedup.heavy_seeds(docs, 50, 12, 101)) == 0


def test_suffix_arrays_and_levels_are_in_the_order_of_bytes():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 99, 60).astype(np.uint8) for _ in range(13)]
    texts[5:8] = texts[1:4]
    family, size = suffix_dedup.IndexFamily(), 8
    for k, text in enumerate(texts):
        array = suffix_dedup.suffix_array(text, np.array([20 - k]), np.array([60 - size + 1]), np.array([k]), size)
        got = [bytes(text[w : w + size]) for w in array.window.tolist()]
        assert got == sorted(got)
        family.add(array)
        kept = [x for x in family.levels if x is not None]
        assert all((x.keys[1:] >= x.keys[:-1]).all() for x in kept)
    assert [x is not None for x in family.levels] == [bool(13 >> i & 1) for i in range(4)]  # levels as a binary counter
    family.close()
    where = {}
    for k, text in enumerate(texts):
        for w in range(60 - size + 1):
            where.setdefault(bytes(text[w : w + size]), []).append((20 - k, k, w))
    want = {(k, w) for all_of in where.values() for d, k, w in all_of if d > min(all_of)[0]}
    got = [(int(e), int(w)) for es, ws in family.found for e, w in zip(es, ws, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_runs_of_equal_fingerprint_but_other_bytes_stay_apart():
    data = np.frombuffer(b"aaaaaaaaaabaaaaaaaaaac", np.uint8)
    runs = repeats.Runs(np.array([0, 10]), np.array([3, 3]), np.array([1, 1], np.uint64), np.array([0, 0]), np.array([9, 9], np.uint64))
    _, first, _ = suffix_dedup._groups(runs, np.array([1, 2]), data, 8)
    assert first.tolist() == [0, 1]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_query_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "labels"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = duck.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    told_of = lambda frame: sorted(tuple(-1 if str(x) in ("nan", "<NA>") else x for x in row) for row in frame.astype(object).values.tolist())
    assert told_of(got) == told_of(want)


def _found(spark, made):
    docs, work = repeats.keyed(cases.documents(spark, made)), Workspace(spark, "test")
    graph, pieces = substring_dedup.met_edges(work, docs, substring_dedup.shared_places(work, docs, 13, 8, 0, 2), 13, 0, 2)
    return substring_dedup.compacted(work, substring_dedup.links(graph)), pieces


def test_paths_without_branches_compact_by_joins(spark):
    words = [f"w{i}" for i in range(900)]
    made = [(1, "p q " + " ".join(words), "en", "s", 0), (2, " ".join(words) + " r", "en", "s", 0)]
    paths, pieces = _found(spark, made)
    assert [(r.doc, r.head, r.end) for r in paths.collect()] == [(1, 2, 889)]
    found = substring_dedup.spans(pieces)
    assert [(r.doc_id, r.start, r["count"], r.source_doc, r.source_start) for r in found.collect()] == [(2, 0, 888, 1, 2)]
    parts = sorted((r.source_start, r["count"], r.start) for r in substring_dedup.parts_of(Workspace(spark, "test"), found, paths, 13).collect())
    assert sum(n for _, n, _ in parts) == 900 and parts[0][0] == 2 and all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:], strict=False))
    assert all(s == a - 2 and n <= 64 for a, n, s in parts)


@pytest.mark.parametrize("n", [13, 14, 76, 77, 78, 140, 141, 205, 333])
def test_paths_of_any_length_and_place(spark, n):
    words = [f"w{i}" for i in range(n)]
    made = [(1, " ".join([f"x{i}" for i in range(61)] + words), "en", "s", 0), (2, " ".join(words), "en", "s", 0)]
    paths, _ = _found(spark, made)
    assert [(r.doc, r.head, r.end) for r in paths.collect()] == ([(1, 61, 61 + n - 13)] if n > 13 else [])


def test_branches_end_paths(spark):
    """Two documents go on differently after a passage, each with a copy: its last node has two ways out."""
    stem, one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    made = [(k, f"{stem} {one if k % 2 else two}", "en", "s", 0) for k in range(4)]
    paths, pieces = _found(spark, made)
    assert {(r.doc, r.head, r.end) for r in paths.collect()} == {(0, 0, 27), (0, 28, 67), (1, 28, 67)}
    parts = substring_dedup.parts_of(Workspace(spark, "test"), substring_dedup.spans(pieces), paths, 13)
    cut = {r.source_start for r in parts.filter("doc_id = 2").collect()}
    assert {0, 28, 40} <= cut  # where paths begin and end


def test_edges_of_a_shard_against_brute_force():
    rng = np.random.default_rng(7)
    runs = []
    for doc in rng.permutation(40):
        n = rng.integers(1, 6, 4)
        runs.append([np.full(4, doc % 25), np.full(4, doc), rng.integers(0, 50, 4).astype("<u4"), n.astype("<u4"), np.ones(4, "u1"), rng.integers(0, 4, int((n + 1).sum())).astype(np.uint64)])
    graph, pieces = substring_dedup.shard_edges(runs)
    seen = []
    for doc, tie, start, count, _, node in runs:
        at = 0
        for d, t, s, c in zip(doc.tolist(), tie.tolist(), start.tolist(), count.tolist(), strict=True):
            seen += [((int(node[at + k]), int(node[at + k + 1])), (d, t, s + k)) for k in range(c)]
            at += c + 1
    by_edge = {}
    for edge, place in seen:
        by_edge.setdefault(edge, []).append(place)
    want = {e: min(ps) for e, ps in by_edge.items() if len({p[0] for p in ps}) > 1}
    assert {(int(a), int(b)): (int(d), int(t), int(p)) for a, b, d, t, p in zip(*graph, strict=True)} == want
    got = Counter((int(d), int(t), int(s) + k, (int(x), int(y), int(z) + k)) for d, t, s, n, x, y, z in zip(*pieces, strict=True) for k in range(int(n)))
    assert got == Counter((*p, want[e]) for e, p in seen if e in want and p[0] > want[e][0])


def test_spans_are_verified_at_their_source(spark):
    a, b = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(200))
    docs = repeats.keyed(cases.documents(spark, [(1, a, "en", "s", 0), (2, f"x {a}", "en", "s", 0), (3, b, "en", "s", 0)]))
    schema = "doc_id long, tie long, start int, count int, source_doc long, source_tie long, source_start int"
    work = Workspace(spark, "test")
    right, wrong = (2, 0, 1, 150, 1, 0, 0), (3, 0, 10, 60, 1, 0, 10)
    assert substring_dedup.mismatches(work, docs, spark.createDataFrame([right], schema)).isEmpty()
    assert [tuple(r)[:4] for r in substring_dedup.mismatches(work, docs, spark.createDataFrame([right, wrong], schema)).select("doc_id", "tie", "start", "count").collect()] == [wrong[:4]]


def test_a_shared_fingerprint_leads_to_another_salt(spark, monkeypatch):
    made = cases.rows()
    real, calls = substring_dedup.mismatches, []

    def first_fails(work, docs, parts):
        calls.append(1)
        return parts.limit(1) if len(calls) == 1 else real(work, docs, parts)

    monkeypatch.setattr(substring_dedup, "mismatches", first_fails)
    got = told(substring_dedup.drop_repeated_words(spark, cases.documents(spark, made)).collect())
    assert len(calls) == 2 and got == Counter(words_expected(made))


def test_kept_text_of_the_query(spark):
    got = queries.op1_substring_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got.filter(F.length("kept_sha256") != 64).isEmpty()
