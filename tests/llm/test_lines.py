"""Line dedup: templates, surroundings, and what is left of documents."""

from collections import defaultdict

import numpy as np
import pytest

from tidepool.llm import line_dedup

from . import cases


def template(line):
    return tuple("#" if any(c in "0123456789" for c in w) else w for w in cases.WORD.findall(line))


def brute(made, min_docs=4, surroundings=0.7):
    """Lines to drop, for texts in which no two different lines are one template."""
    seen = defaultdict(lambda: (set(), set(), set()))
    docs = {(r[0], r[1] or "") for r in made}
    for doc in docs:
        lines = [template(x) for x in doc[1].split("\n") if cases.WORD.search(x)]
        for before, x, after in zip([None, *lines], lines, [*lines[1:], None], strict=False):
            for s, v in zip(seen[x], (doc, before, after), strict=True):
                s.add(v)
    return {k for k, (d, b, a) in seen.items() if len(d) >= min_docs and max(len(b), len(a)) >= surroundings * len(d)}


def kept(text, dropped):
    out = []
    for x in (text or "").split("\n"):
        if template(x) not in dropped:
            out.append(x)
    return out


def test_against_brute_force(spark):
    made = cases.rows() + [(500 + k, f"head {k} of {k}\nCopyright {1990 + k} by us\nbody number {'x' * (k + 1)}", "en", "s", 0) for k in range(9)]
    dropped = brute(made)
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(spark, cases.clashing(cases.documents(spark, made)), similarity=1.0).collect()}
    for r in made:
        left = kept(r[1], dropped)
        n = (r[1] or "").count("\n") + 1
        text = r[1] if len(left) == n else "\n".join(left)
        assert got[r[0], text] == (n, n - len(left))
    assert ("Copyright", "#", "by", "us") in dropped


def test_variable_words_are_one_template(spark):
    names = ["anna", "boris", "carla", "dieter", "emil", "fatima"]
    made = [(k, f"first thoughts {'abcdef'[k] * 3}\nthis page was written by {n} for all of our dear readers\nlast {'uvwxyz'[k] * 4}", "en", "s", 0) for k, n in enumerate(names)]
    got = line_dedup.drop_lines(spark, cases.documents(spark, made)).collect()
    assert all(r.n_dropped == 1 and "written by" not in r.text for r in got)


def test_copied_documents_keep_their_lines(spark):
    made = [(k, "alpha beta gamma\ndelta epsilon zeta\neta theta iota", "en", "s", 0) for k in range(30)]
    assert all(r.n_dropped == 0 for r in line_dedup.drop_lines(spark, cases.documents(spark, made)).collect())


def test_footers_of_several_lines_go(spark):
    footer = "all rights reserved\nwrite to us\nabout this site\nback to top"
    made = [(k, f"{'abcdefghij'[k % 10]}{'x' * k} one\n{'y' * (k + 1)} two\n{'z' * (k + 1)} three\n{footer}", "en", "s", 0) for k in range(40)]
    got = line_dedup.drop_lines(spark, cases.documents(spark, made)).collect()
    assert all(r.n_dropped == 4 and r.text.count("\n") == 2 for r in got)


def test_copies_do_not_mask_boilerplate(spark):
    """A line in 14 texts, in 10 copies of one text and in 10 near copies of it."""
    line, names = "subscribe to our letter", "abcdefghijklmn"
    made = [(k, f"{n * 3} one\n{n * 4} two\n{line}\n{n * 5} three\n{n * 6} four", "en", "s", 0) for k, n in enumerate(names)]
    copy = ["first of copy", "second of copy", line, "third of copy", "fourth of copy", "fifth of copy"]
    made += [(100 + k, "\n".join(copy), "en", "s", 0) for k in range(10)]
    made += [(200 + k, "\n".join([*copy[:4], f"{'pqrstuvwxy'[k] * 4} changed", copy[5]]), "en", "s", 0) for k in range(10)]
    got = line_dedup.drop_lines(spark, cases.documents(spark, made)).collect()
    assert all(line not in r.text and r.n_dropped == 1 for r in got)


def test_documents_keep_columns_and_count_anew(spark):
    made = cases.rows()
    docs = cases.clashing(cases.documents(spark, made))
    cut = line_dedup.cut_documents(spark, docs)
    assert cut.schema.simpleString() == docs.schema.simpleString()
    was = {(r[0], r[4]) for r in made}
    for r in cut.collect():
        assert (r.doc_id, r.n_chars) in was or r.n_chars == len(r.text)
    assert line_dedup.cut_documents(spark, cases.documents(spark, [])).count() == 0
    assert line_dedup.drop_lines(spark, cases.documents(spark, [])).count() == 0


def test_leaf_groups():
    tokens = np.array([[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [9, 9, 9, 9, 9], [1, 2, 3, 7, 8]], np.uint32)
    got = line_dedup.group_leaf(np.array([10, 11, 12, 13]), tokens, 0.8)
    assert got.tolist() == [10, 10, 12, 13]


def plain_groups(lines, tokens, similarity):
    """group_leaf as its rule says, each line with every template."""
    found = []
    out = []
    for line, own in zip(lines.tolist(), tokens.tolist(), strict=True):
        scores = [sum(a == b for a, b in zip(t[1], own, strict=True)) for t in found]
        best = max(scores, default=-1)
        if best >= similarity * len(own):
            t = found[scores.index(best)]
            t[1] = [a if a == b else None for a, b in zip(t[1], own, strict=True)]
            out.append(t[0])
        else:
            found.append([line, own])
            out.append(line)
    return out


def test_groups_of_large_leaves_and_ties():
    rng = np.random.default_rng(3)
    for size, n, values in ((4, 200, 3), (7, 300, 3), (10, 300, 2), (15, 200, 2), (5, 400, 6)):
        tokens = rng.integers(0, values, (n, size)).astype(np.uint32)
        lines = np.arange(n)
        for similarity in (0.6, 0.8, 1.0):
            assert line_dedup.group_leaf(lines, tokens, similarity).tolist() == plain_groups(lines, tokens, similarity)


@pytest.mark.parametrize("size", range(1, 11))
def test_footers_of_any_size_go_and_copies_stay(spark, size):
    footer = "\n".join(f"footer line {'abcdefghij'[k] * 3} here" for k in range(size))
    made = [(k, f"{'x' * (k + 1)} one\n{'y' * (k + 1)} two\n{footer}", "en", "s", 0) for k in range(12)]
    made += [(100 + k, "first of all copies\nsecond of all copies\nthird of all copies", "en", "s", 0) for k in range(9)]
    got = line_dedup.drop_lines(spark, cases.documents(spark, made)).collect()
    assert all(r.n_dropped == (size if r.doc_id < 100 else 0) for r in got)
