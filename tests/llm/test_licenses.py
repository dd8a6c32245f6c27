"""The licence scan: base places against brute force, and what the index adds."""

import re
from collections import Counter

from tidepool.llm import license_scan

from . import cases

LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = LICENCE_WORD.findall((text or "").translate(cases.LOWER))
    at, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        k = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(k)] == k]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places(spark):
    made = cases.rows() + [(900, "mit license " * 50 + "Apache  License", None, None, 0), (901, "MITLicense mit-license", None, None, 0)]
    got = license_scan.scan(spark, cases.clashing(cases.documents(spark, made))).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((r[0], *base(r[1])) for r in made)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got)


def test_index_finds_wordings_and_leaves_prose_alone(spark):
    made = [
        (1, "x y. Licensed under CC BY-NC 4.0. z", "en", "s", 0),
        (2, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "en", "s", 0),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "en", "s", 0),
        (4, "the source of this software is subject to a charge and any person with permission", "en", "s", 0),
        (5, "source forms and binary redistribution without use modification permitted following conditions", "en", "s", 0),
    ]
    made += [(10 + k, f"prose number {k} about the weather and a walk", "en", "s", 0) for k in range(200)]
    got = {r.doc_id: r for r in license_scan.scan(spark, cases.documents(spark, made)).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["cc-by-nc", "bsd", "mit", "", ""]
    assert got[4].score == 0.0


def test_a_file_of_all_templates_has_all_labels(spark):
    made = [(1, "\n\n".join(x[1] for x in license_scan.TEMPLATES), "en", "s", 0)]
    made += [(10 + k, f"prose number {k} about the weather and a walk", "en", "s", 0) for k in range(200)]
    got = {r.doc_id: r for r in license_scan.scan(spark, cases.documents(spark, made)).collect()}
    assert got[1].labels == ",".join(sorted({x[0] for x in license_scan.TEMPLATES})) and got[1].score == 1.0


def test_empty_table(spark):
    assert license_scan.scan(spark, cases.documents(spark, [])).count() == 0
