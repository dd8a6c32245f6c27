"""The pipeline's stages keep columns, take awkward tables, and do what they say."""

from collections import defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from tidepool.llm import line_dedup, quality_classifier
from tidepool.llm.common import Workspace

from . import cases
from ..conftest import SF_MID as SF


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, name, stage):
    docs = cases.clashing(cases.documents(spark))
    assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
    assert stage(spark, cases.documents(spark, []), SF).count() == 0


def test_pack_takes_every_table(spark):
    pack = dict(corpus_pipeline.STAGES)["pack"]
    made = cases.rows()
    got = pack(spark, cases.clashing(cases.documents(spark, made)), SF).collect()
    assert {r.doc_id for r in got} == {r[0] for r in made} and sum(r.start == 0 for r in got) == len(made)
    assert pack(spark, cases.documents(spark, []), SF).count() == 0


def test_quality_and_lines_do_what_the_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_classifier.score(docs, model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in stages["quality"](spark, docs, SF).collect()} == good
    cut = {r.doc_id: r.text for r in line_dedup.drop_lines(spark, docs).collect()}
    assert {r.doc_id: r.text for r in stages["lines"](spark, docs, SF).collect()} == {d: t for d, t in cut.items() if cases.WORD.search(t or "") or t == dict(zip(*(cases.sample("documents", SF)[c] for c in ("doc_id", "text")), strict=True))[d]}


def test_near_duplicates_against_brute_force(spark):
    """All pairs of the table by the similarity of their sets of 5-word shingles."""
    table = cases.sample("documents", SF)
    holders, sizes = defaultdict(list), {}
    for d, text in zip(table["doc_id"], table["text"], strict=True):
        words = cases.WORD.findall((text or "").translate(cases.LOWER))
        shingles = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        sizes[d] = len(shingles)
        for s in shingles:
            holders[s].append(d)
    shared = defaultdict(int)
    for ds in holders.values():
        for pair in combinations(sorted(ds), 2):
            shared[pair] += 1
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (sizes[a] + sizes[b] - n)] + list(combinations(sorted(d for d, n in sizes.items() if not n), 2))
    parent = {d: d for d in sizes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {d for d in sizes if root(d) == d}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert want <= kept and len(kept - want) <= 0.03 * (len(sizes) - len(want)) and len(sizes) - len(want) > 50


def test_benchmark_leaks_against_brute_force(spark):
    """Documents that hold an item, word by word, within a fifth of its words in edits."""
    items = [cases.WORD.findall(t.lower()) for t in cases.sample("benchmark", SF)["text"]]
    strip = lambda ws: [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in ws]
    items = [strip(x) for x in items]
    table = cases.sample("documents", SF, 150)
    clean = set()
    for d, text in zip(table["doc_id"], table["text"], strict=True):
        words = np.array(strip(cases.WORD.findall((text or "").translate(cases.LOWER))) or [""])
        hit = False
        for item in items:
            row, step = np.zeros(len(words) + 1, np.int64), np.arange(len(words) + 1)
            for x in item:
                now = row + 1
                now[1:] = np.minimum(now[1:], row[:-1] + (words != x))
                row = np.minimum.accumulate(now - step) + step
            hit = hit or row.min() <= int(0.2 * len(item))
        clean |= set() if hit else {d}
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(f"doc_id in ({','.join(map(str, table['doc_id']))})")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["benchmark_leaks"](spark, docs, SF).collect()} == clean


def test_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    tokens = {r.doc_id: r.doc_tokens for r in got}
    assert len(tokens) > 50 and sum(r.length for r in got) == sum(tokens.values())
    items = cases.sample("benchmark", SF)["text"]
    texts = dict(zip(*(cases.sample("documents", SF)[c] for c in ("doc_id", "text")), strict=True))
    assert not any(item in texts[d] for d in tokens for item in items)
    marked = cases.sample("labels", SF)
    bad = {d for d, q in zip(marked["doc_id"], marked["quality"], strict=True) if not q}
    assert len(bad & set(tokens)) <= 0.2 * len(bad)


class _Cluster:
    """As much of a session as a folder is chosen by."""

    class _Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return self

        def get(self, name, default=None):
            return default

    sparkContext = conf = _Context()


def test_a_cluster_has_to_name_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        Workspace(_Cluster(), "test")
