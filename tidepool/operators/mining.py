"""Mining of confusable pairs and new terms for the dictionary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vec
from .leader import Embed


def sound_key(text: Column) -> Column:
    """A key for texts that sound alike where no pinyin table is at hand: lower case, letters only, no vowels."""
    return F.regexp_replace(F.lower(text), "[^a-z]|[aeiou]", "")


def candidates(registry: DataFrame, sample: int = 2000) -> DataFrame:
    """Texts of 3 to 16 characters seen at least twice; at most ``sample`` of them, by their MD5 (a sampling operator)."""
    return registry.filter(F.length("canonical").between(3, 16) & (F.col("n") >= 2)).orderBy(F.md5("canonical")).limit(sample).select("canonical", "n")


def confusable_pairs(candidates: DataFrame, low: float = 0.5, high: float = 0.75, edits: int = 3, embed: Embed | None = None, keys: DataFrame | None = None) -> DataFrame:
    """a < b, similarity and kind among the sampled candidates: "spelling" if their similarity is between low and high,
    "sound" if it is lower and their keys differ in at most ``edits`` edits.

    Similarity is that of trigrams, or of the vectors that embed gives; keys are made of the letters, or taken from keys
    (token, key), and a text that it has not has none."""
    held = candidates.withColumn("key", sound_key(F.col("canonical")))
    if keys is not None:
        held = candidates.join(keys.select(F.col("token").alias("canonical"), "key"), "canonical", "left")
    if embed is None:
        held, of = held.withColumn("of", F.array_distinct(tx.ngrams(F.col("canonical")))), tx.jaccard
    else:
        vectors = F.pandas_udf(lambda texts: pd.Series([x.tolist() for x in embed(texts.tolist())]), "array<double>")
        held, of = held.withColumn("of", vectors("canonical")), vec.dot
    side = lambda s: held.select(F.col("canonical").alias(s), F.col("of").alias(f"of_{s}"), F.col("key").alias(f"k_{s}"))
    met = tx.dealt(side("a")).join(side("b"), F.col("a") < F.col("b"))
    scored = met.withColumn("similarity", F.round(of(F.col("of_a"), F.col("of_b")), 6))
    kind = F.when(F.col("similarity").between(low, high), "spelling").when((F.col("similarity") < low) & (F.levenshtein("k_a", "k_b") <= edits), "sound")
    return scored.withColumn("kind", kind).filter("kind is not null").select("a", "b", "similarity", "kind")


def new_terms(registry: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that no known text equals: canonical, n; known: canonical."""
    return registry.filter(F.length("canonical").between(3, 16) & (F.col("n") >= 2)).join(known, "canonical", "left_anti").select("canonical", "n")


def confirmed(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """variant and canonical for confirmed pairs: the more frequent side is canonical, a at ties."""
    count = lambda s: registry.select(F.col("canonical").alias(s), F.col("n").alias(f"n_{s}"))
    met = pairs.join(count("a"), "a", "left").join(count("b"), "b", "left").fillna(0, ["n_a", "n_b"])
    keep = F.col("n_a") >= F.col("n_b")
    return met.select(F.when(keep, F.col("b")).otherwise(F.col("a")).alias("variant"), F.when(keep, F.col("a")).otherwise(F.col("b")).alias("canonical"))
