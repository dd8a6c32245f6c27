"""Quality rules and the quality classifier."""

import re
import zlib
from collections import Counter

import numpy as np

from tidepool.llm import quality_classifier, quality_rules

from . import cases
from ..conftest import SF_MID as SF

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    words = cases.WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in (i, i + 1, i + 2)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if cases.WORD.search(line):
            again += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_against_brute_force(spark):
    rng = np.random.default_rng(2)
    made = cases.rows() + [(600 + k, " ".join(f"w{x}" for x in rng.integers(0, k + 3, 12 * (k + 1))), "en", "s", 0) for k in range(25)]
    got = quality_rules.judge(cases.clashing(cases.documents(spark, made)), []).collect()
    of = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    assert of == Counter((r[0], *base(r[1]), not base(r[1])[-1]) for r in made)


def test_rules_are_learned_and_keep_good_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learn_rules(docs, labels)
    kept = {r.doc_id: r for r in quality_rules.judge(docs, rules).collect()}
    marked = cases.sample("labels", SF)
    pairs = [(q, kept[d]) for d, q in zip(marked["doc_id"], marked["quality"], strict=True)]
    good = [r.kept for q, r in pairs if q and not r.base_failed]
    bad = [r.kept for q, r in pairs if not q]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.25


def test_verdict_is_the_first_rule_that_covers(spark):
    """The ordered conditional against rules applied row by row, on features counted the long way round."""
    made = [(i, t, "en", "s", 0) for i, t in enumerate(cases.sample("documents", SF, 300)["text"])]
    condition = quality_rules.Condition
    rules = [
        (condition("symbols_per_word", True, 0.02), condition("n_words", True, 60.0)),
        (condition("word_length", False, 4.9), condition("repeated_share", True, 0.01)),
        (condition("upper_share", True, 0.08), condition("bangs_per_word", True, 0.001)),
        (condition("dup_lines_per_word", True, 0.0),),
    ]

    def features_of(text):
        n, chars, symbols, dups, repeats, failed = base(text)
        ratio = lambda a, b: a / b if b else 0.0
        upper = len(re.findall("[A-Z]", text or ""))
        return failed, dict(n_words=float(n), word_length=ratio(chars, n), symbols_per_word=ratio(symbols, n), dup_lines_per_word=ratio(dups, n), repeated_share=ratio(repeats, n), upper_share=ratio(upper, chars), bangs_per_word=ratio((text or "").count("!"), n))

    want = {}
    for i, t, *_ in made:
        failed, row = features_of(t)
        want[i] = not failed and not any(all(c.holds(row) for c in rule) for rule in rules)
    got = {r.doc_id: r.kept for r in quality_rules.judge(cases.documents(spark, made), rules).collect()}
    assert got == want and 20 < sum(want.values()) < 280


def test_rows_of_one_document_stand_as_one_that_exists(spark):
    docs = cases.documents(spark, [(1, "a " * 60, "en", "s", 0), (1, "word! " * 80, "en", "s", 0)])
    labels = spark.createDataFrame([(1, 0, 0)], LABELS)
    (row,) = quality_rules.labelled_sample(docs, labels, 10)
    assert (row["n_words"], row["bangs_per_word"]) in {(60.0, 0.0), (80.0, 1.0)} and row["bad"] == 1


def test_learning_covers_a_planted_conjunction():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(900):
        row = {f: float(rng.random()) for f in quality_rules.FEATURES}
        rows.append(row | {"bad": int(row["upper_share"] > 0.7 and row["bangs_per_word"] > 0.5), "prune": k % 3 == 0})
    rules = quality_rules.learn(rows)
    told = [any(all(c.holds(r) for c in rule) for rule in rules) for r in rows]
    assert np.mean([t == bool(r["bad"]) for t, r in zip(told, rows, strict=True)]) > 0.97


def test_labels_of_one_kind_null_or_none(spark):
    docs = cases.documents(spark)
    for made in ([], [(5, 1, 0), (6, None, 0), (None, 0, 0), (77, 0, 1)]):
        labels = spark.createDataFrame(made, LABELS)
        assert quality_rules.learn_rules(docs, labels) == []
        got = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
        assert len(got) == len(cases.rows()) and {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    nothing = cases.documents(spark, [])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    assert quality_rules.judge(nothing, quality_rules.learn_rules(nothing, labels)).count() == 0
    assert quality_classifier.score(nothing, quality_classifier.fit(nothing, labels)).count() == 0


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    marked = cases.sample("labels", SF)
    right = [got[d].predicted == q for d, q in zip(marked["doc_id"], marked["quality"], strict=True) if got[d].held_out]
    assert len(right) > 5 and np.mean(right) > 0.85


def test_classifier_handles_every_text_and_keeps_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    odd = cases.clashing(cases.documents(spark))
    scores = quality_classifier.score(odd, model).collect()
    assert len(scores) == len(cases.rows()) and all(0 <= r.score <= 1 for r in scores)
    kept = quality_classifier.keep_good(odd, model)
    assert kept.schema == odd.schema and kept.count() == sum(r.predicted for r in scores)


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 200, 30) + (100 if k % 2 else 0)) for k in range(200)]
    good = np.array([k % 2 == 1 for k in range(200)])
    w, b = quality_classifier.dual_descent(rows, np.ones(300), good, 1.0, 50)
    told = np.array([w[x].sum() / len(x) ** 0.5 + b > 0 for x in rows])
    assert (told == good).mean() > 0.98


def test_model_against_a_dense_one():
    """Log-count ratios, unit rows and the hinge-loss optimum, written with dense matrices."""
    rng = np.random.default_rng(5)
    n, size = 120, quality_classifier.SIZE + quality_classifier.SHARES
    on = rng.random((n, 40)) < np.where(np.arange(n)[:, None] % 2, 0.5, 0.3)
    good = np.arange(n) % 2 == 1
    rows = [np.flatnonzero(x) for x in on]
    model = quality_classifier.fit_rows(list(range(n)), rows, good, rounds=2000)
    counts = [np.ones(size) for _ in range(2)]
    for x, g in zip(on, good, strict=True):
        counts[int(g)][:40] += x
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    dense = on * ratio[:40]
    dense /= np.maximum(1e-12, np.sqrt((dense**2).sum(axis=1, keepdims=True)))
    y = np.where(good, 1.0, -1.0)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (dense @ w + b)).sum()

    # the weights that the model holds are those of the dense rows, scaled by the ratios
    w, b = model.weight[:40] / np.where(ratio[:40] == 0, 1, ratio[:40]), model.intercept
    best, v, c = np.inf, np.zeros(40), 0.0
    for step in range(1, 20001):  # subgradient descent from nothing
        out = y * (dense @ v + c) < 1
        gv, gc = v - (y[out, None] * dense[out]).sum(axis=0), c - y[out].sum()
        v, c = v - gv / (step + 50), c - gc / (step + 50)
        best = min(best, loss(v, c))
    assert loss(w, b) <= best * 1.01
    told = np.array([model.margin(np.isin(np.arange(size), r)) for r in rows])
    assert np.allclose(told, dense @ w + b, atol=1e-3)
