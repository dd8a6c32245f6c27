"""Token counts and packing against the tokenizer itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidepool.llm import packing, token_counts

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(PATH)


def test_counts_against_the_library(spark, exact):
    made = cases.rows()
    got = token_counts.token_counts(cases.clashing(cases.documents(spark, made)), PATH, 512).collect()
    size = lambda t: len(exact.encode(t or "", add_special_tokens=False).ids)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((r[0], len((r[1] or "").encode()), n := size(r[1]), n > 512) for r in made)
    assert token_counts.token_counts(cases.documents(spark, []), PATH, 512).count() == 0


ODD = ["a", "b", " ", "  ", "'", "l", "s", "re", "ve", "\n", "\t", "<|endoftext|>", "<|", "é", "日", "\x85", "\xa0", "\u3000", "!", "1", "²", "ª", "\x1c", "the ", "ing", "…", "€", "\u2028", "😀"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30) | st.lists(st.sampled_from(ODD), max_size=14).map("".join))
def test_every_prefix(text):
    enc = token_counts.encoder(PATH)
    table = token_counts.PrefixCounts(enc.table(text))
    ids = lambda t: enc.exact.encode(t, add_special_tokens=False).ids
    assert table.total == len(ids(text)) == enc.total(enc.table(text))
    assert enc.ids(text).tolist() == ids(text)
    for k in range(len(text) + 1):
        assert table.at(len(text[:k].encode())) == len(ids(text[:k]))


def test_long_pieces(exact):
    enc = token_counts.encoder(PATH)
    for text in ("x" * 5000, "ab" * 3000, " " * 4000 + "x", "=-" * 2000, "日本" * 1500):
        assert token_counts.PrefixCounts(enc.table(text)).total == len(exact.encode(text, add_special_tokens=False).ids)


def test_budget_questions(exact):
    enc = token_counts.encoder(PATH)
    text = cases.texts()[5]
    table = token_counts.PrefixCounts(enc.table(text))
    size = lambda t: len(exact.encode(t, add_special_tokens=False).ids)
    for budget in (0, 1, 7, table.total - 1, table.total, table.total + 5):
        cut = table.truncation(budget)
        assert table.fits(budget) == (table.total <= budget)
        prefix = text.encode()[:cut].decode()
        assert size(prefix) <= budget
        assert all(size(text[:k]) > budget for k in range(len(prefix) + 1, min(len(text), len(prefix) + 30) + 1))


def test_stored_tables(spark, exact):
    """The tables as stored: one step for each byte, counts of all prefixes in their running sums."""
    got = token_counts.prefix_tables(cases.documents(spark), PATH).collect()
    made = {r[0]: r[1] or "" for r in cases.rows() if r[0] is not None and r[0] != 8}
    for r in got:
        if r.doc_id in made:
            text = made[r.doc_id]
            table = token_counts.PrefixCounts(np.frombuffer(r.steps, np.int8))
            assert len(r.steps) == len(text.encode())
            for k in {0, len(text) // 3, len(text) // 2, len(text)}:
                assert table.at(len(text[:k].encode())) == len(exact.encode(text[:k], add_special_tokens=False).ids)


def test_counts_come_from_the_stored_tables(spark, monkeypatch):
    made = [(1, "one two three", "en", "s", 0)]
    real = token_counts.prefix_tables
    monkeypatch.setattr(token_counts, "prefix_tables", lambda docs, path: real(docs, path).selectExpr("doc_id", "unhex('0102') as steps"))
    assert [tuple(r)[:3] for r in token_counts.token_counts(cases.documents(spark, made), PATH, 512).collect()] == [(1, 2, 3)]


def test_text_of_over_a_megabyte(spark, exact):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice(["ka", "lo", "mi", "nu"]) for _ in range(rng.randint(1, 5))) for _ in range(200_000))
    got = token_counts.token_counts(cases.documents(spark, [(1, text, "en", "s", 0), (2, "b", "en", "s", 0)]), PATH, 512).collect()
    assert len(text) > 1 << 20 and {r.doc_id: r.n_tokens for r in got} == {1: len(exact.encode(text, add_special_tokens=False).ids), 2: 1}


def test_packing_round_trip(spark, exact):
    made = cases.rows()
    got = packing.pack(cases.clashing(cases.documents(spark, made)), PATH, group_docs=16).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    want = defaultdict(list)
    for r in made:
        ids = np.array([*exact.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want[r[0], len(ids)] += [(s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes())) for s in range(0, len(ids), 1024)]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(cases.documents(spark, []), PATH).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(6)
    lengths = np.array(sorted((rng.randint(1, 64) for _ in range(500)), reverse=True))
    into, offset = packing.best_fit_decreasing(lengths, 64)
    room: dict[int, int] = {}
    for size, w, o in zip(lengths.tolist(), into.tolist(), offset.tolist(), strict=True):
        fits = [r for r in room.values() if r >= size]
        assert room.get(w, 64) == (min(fits) if fits else 64) and o == 64 - room.get(w, 64)
        room[w] = 64 - o - size


def test_rows_without_a_doc_id_are_dealt_to_many_groups(spark):
    """Equal pieces share no group by their being equal, and each comes out once."""
    made = [(None, "", "en", "s", 0)] * 300 + [(7, "two words", "en", "s", 0)] * 300
    got = packing.pack(cases.documents(spark, made), PATH, group_docs=20).collect()
    assert Counter((r.doc_id, r.length) for r in got) == {(None, 1): 300, (7, 3): 300}
    groups = Counter(r.sequence_id % 30 for r in got)
    assert len(groups) > 20 and max(groups.values()) < 60
    assert len({(r.sequence_id, r.offset) for r in got}) == 600
