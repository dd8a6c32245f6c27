"""Texts of over a megabyte: every operator that is not tested with such ones elsewhere."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidepool.llm import decontaminate, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash_dedup

from . import cases
from .test_licenses import base as licence_base
from .test_quality import base as quality_base
from .test_simhash import fingerprint
from ..conftest import SF_MID as SF

ITEM = "the quick brown fox jumps over the lazy dog while nobody else looks at the garden fence today"


@pytest.fixture(scope="module")
def made():
    rng = random.Random(21)
    words = ["".join(rng.choice(["ka", "lo", "mi", "nu", "ré", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(5000)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(16_000)]
    lines[9000:9000] = [ITEM, "MIT License", lines[10], lines[11]]
    long = "\n".join(lines)
    assert len(long) > 1 << 20
    return [(1, long, "en", "s", 0), (2, long + " more", "en", "s", 0), (3, "a short one", "en", "s", 0), (4, "z" * (1 << 20), "en", "s", 0)]


def test_rules(spark, made):
    got = {r.doc_id: r for r in quality_rules.judge(cases.documents(spark, made), []).collect()}
    for r in made:
        x = got[r[0]]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == quality_base(r[1])


def test_licences(spark, made):
    got = {r.doc_id: r for r in license_scan.scan(spark, cases.documents(spark, made)).collect()}
    for r in made:
        x = got[r[0]]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == licence_base(r[1])
    assert got[1].labels == "mit"


def test_decontamination(spark, made):
    items = spark.createDataFrame([(7, ITEM), (8, "nothing of this kind stands in any of the texts here at all")], "item_id long, text string")
    docs = cases.documents(spark, made)
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_items(spark, docs, items).collect()} == {(1, 7, 0), (2, 7, 0)}
    assert {r.doc_id for r in decontaminate.keep_clean(spark, docs, items).collect()} == {3, 4}


def test_classifier(spark, made):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.score(cases.documents(spark, made), quality_classifier.fit(docs, labels)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4} and all(0 <= r.score <= 1 for r in got)


def test_simhash(spark, made):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(spark, cases.documents(spark, made)).collect()}
    assert got == {r[0]: (f"{fingerprint(r[1]):016x}", 1 if r[0] < 3 else r[0]) for r in made}
    assert {r.doc_id for r in simhash_dedup.keep_one(spark, cases.documents(spark, made)).collect()} == {1, 3, 4}


def test_packing(spark, made):
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    got = packing.pack(cases.documents(spark, made), path).collect()
    for r in made:
        ids = np.array([*exact.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
        own = sorted((x.start, x.length, x.ids_crc32) for x in got if x.doc_id == r[0])
        assert own == [(s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes())) for s in range(0, len(ids), 1024)]


def test_lines(spark, made):
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(spark, cases.documents(spark, made)).collect()}
    assert got == {r[0]: (r[1].count("\n") + 1, 0) for r in made}
