"""Licence scan by a positional index of rare licence words.

The templates below are public wordings.  Every content word of a template is posted with its place there.  One pass
over the texts notes where these words stand; document frequencies come from that, over all documents.

A template counts only where its mandatory key phrase stands in full, so of each template the rarest word of that
phrase (the highest IDF) is looked up in the files: every place where it stands is a candidate alignment, and none is
lost.  The other postings are looked up at their relative places only where there is a candidate.  An alignment counts
if the whole key phrase is there and the words matched carry enough of the template's IDF.  However many templates a
file holds, each is judged for itself.  All of it is DataFrame work; the postings are as small as the templates and are
broadcast.

Defined cases: null and empty texts have no words, no labels and score 0.  Rows with an equal doc_id are
scanned each for itself.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, texts_of

# Phrases and labels that always count.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, wording, mandatory key phrase.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "file except"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]

# Words of the templates that are not posted.
STOP = frozenset("a an any are as at in is it may not of or that the this to with you use and".split())

LOWER, CAPITALS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _postings(spark: SparkSession) -> DataFrame:
    """word, template, place for each posted word; key words are posted even if they are stop words."""
    rows = []
    for t, (_, wording, key) in enumerate(TEMPLATES):
        words, keys = wording.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(keys)] == keys)
        rows += [(w, t, i, at <= i < at + len(keys)) for i, w in enumerate(words) if w not in STOP or at <= i < at + len(keys)]
    return spark.createDataFrame(rows, "word string, template int, place int, mandatory boolean")


def _vocabulary() -> list[str]:
    keys = {w for _, _, key in TEMPLATES for w in key.split()}
    return sorted(({w for _, x, _ in TEMPLATES for w in x.split()} - STOP) | keys | {w for p in BASE for w in p.split()})


def _stands(words: Column, i: Column, phrase: str) -> Column:
    out = F.lit(True)
    for k, w in enumerate(phrase.split()):
        out = out & F.coalesce(F.get(words, i + k) == w, F.lit(False))
    return out


def _found(words: Column) -> Column:
    """Places of posted words, and of the base phrases."""
    index = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(index, lambda i: F.get(words, i).isin(_vocabulary()))

    def of(hits: Column) -> Column:
        def at(phrase: str, label: str) -> Column:
            return F.transform(F.filter(hits, lambda i: _stands(words, i, phrase)), lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))

        phrases = [at(*x) for x in BASE.items()]
        return F.struct(F.size(words).alias("n_words"), F.transform(hits, lambda i: F.struct(F.get(words, i).alias("word"), i.alias("place"))).alias("hits"), F.concat(*phrases).alias("base"))

    return F.transform(F.array(hits), of)[0]


def scan(spark: SparkSession, docs: DataFrame, least_share: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    work = Workspace(spark, "licenses")
    words = F.array_remove(F.split(F.translate("text", CAPITALS, LOWER), BETWEEN), "")
    read = texts_of(docs).select("doc_id", F.transform(F.array(words), _found)[0].alias("x")).select("doc_id", "x.*")
    read = work.write(read.withColumn("row", F.monotonically_increasing_id()), "places")

    n_docs = read.count()
    hits = read.select("row", F.explode("hits").alias("h")).select("row", "h.word", F.col("h.place").alias("hits_place"))
    frequency = hits.groupBy("word", "row").agg(F.lit(1).alias("one")).groupBy("word").agg(F.count("*").alias("n"))
    # a word that no document has is as rare as can be
    posted = _postings(spark)
    idf = posted.select("word").distinct().join(F.broadcast(frequency), "word", "left").select("word", F.log((F.lit(n_docs) + 1.0) / (F.coalesce("n", F.lit(0)) + 0.5)).alias("idf"))
    idf = work.write(idf, "idf")  # as many rows as the templates have words
    weighted = posted.join(F.broadcast(idf), "word")
    whole = weighted.groupBy("template").agg(F.sum("idf").alias("whole"), F.sum(F.col("mandatory").cast("int")).alias("n_mandatory"))

    rarest = weighted.filter("mandatory").groupBy("template").agg(F.max_by(F.struct("word", "place"), F.struct("idf", -F.col("place"), "word")).alias("a")).select("template", "a.word", "a.place")
    candidates = hits.join(F.broadcast(rarest), "word").select("row", "template", (F.col("hits_place") - F.col("place")).alias("shift"))
    asked = candidates.join(F.broadcast(weighted), "template").select("row", "template", "shift", "word", (F.col("shift") + F.col("place")).alias("hits_place"), "idf", "mandatory")
    aligned = asked.join(hits, ["row", "word", "hits_place"]).groupBy("row", "template", "shift").agg(F.sum("idf").alias("matched"), F.sum(F.col("mandatory").cast("int")).alias("keys"))
    labels = spark.createDataFrame([(t, x[0]) for t, x in enumerate(TEMPLATES)], T.StructType([T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType())]))
    share = F.round(F.col("matched") / F.col("whole"), 6)  # sums of decimals differ in their last places with their order
    kept = (
        aligned.join(F.broadcast(whole), "template")
        .filter((F.col("keys") == F.col("n_mandatory")) & (share >= least_share))
        .join(F.broadcast(labels), "template")
        .groupBy("row")
        .agg(F.collect_set("label").alias("found"), F.max(share).alias("share"))
    )
    none = F.array().cast("array<string>")
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    places = F.transform("base", lambda b: b["place"])
    joined = read.join(kept, "row", "left")
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))).alias("score"),
    )
