"""Dictionary operators: whole texts by a join, tokens by a greedy kernel, keys that name one term."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.dictionaries import VARIANTS, entries


def pairs(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(entries.items()), "variant string, replacement string")


def replace_whole(canonical: DataFrame, dictionary: DataFrame) -> DataFrame:
    """seq and normalized: the text, or what the dictionary has for it in lower case."""
    of = canonical.withColumn("variant", F.lower("canonical"))
    return of.join(dictionary, "variant", "left").select("seq", F.coalesce("replacement", "canonical").alias("normalized"))


def segment(text: str, vocabulary: set[str], longest: int) -> list[str]:
    """A whole run of Latin letters and digits, else the longest word of the vocabulary that begins here, else one character."""
    out, i = [], 0
    latin = lambda c: c.isascii() and c.isalnum()
    while i < len(text):
        size = 1
        if latin(text[i]):
            while i + size < len(text) and latin(text[i + size]):
                size += 1
        else:
            size = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in vocabulary), 1)
        out.append(text[i : i + size])
        i += size
    return out


def replaced(tokens: list[str], dictionary: dict[str, str]) -> list[tuple[str, bool]]:
    """From left to right, the longest join of up to four tokens that the dictionary has becomes its canonical; with
    each piece, whether it is a token that the dictionary has not."""
    out, i = [], 0
    while i < len(tokens):
        for n in range(min(4, len(tokens) - i), 0, -1):
            if (joined := "".join(tokens[i : i + n])) in dictionary:
                out.append((dictionary[joined], False))
                i += n
                break
        else:
            out.append((tokens[i], True))
            i += 1
    return out


Segment = Callable[[str], list[str]]


@dataclass(frozen=True)
class Lexicon:
    """A dictionary of variants with the segmenter that cuts texts into tokens, by default forward maximum match."""

    words: tuple[tuple[str, str], ...]
    segmenter: Segment | None = None

    @classmethod
    def of(cls, entries: dict[str, str], segmenter: Segment | None = None) -> Lexicon:
        return cls(tuple(entries.items()), segmenter)

    def cut(self) -> Segment:
        if self.segmenter is not None:
            return self.segmenter
        vocabulary = {w for pair in self.words for w in pair}
        longest = max(map(len, vocabulary), default=1)
        return lambda text: segment(text, vocabulary, longest)

    def pieces(self) -> Callable[[Column], Column]:
        """A column function: the text's pieces (text, open: a token that the dictionary has not)."""
        cut, words = self.cut(), dict(self.words)

        @F.pandas_udf("array<struct<text: string, open: boolean>>")
        def of(texts: pd.Series) -> pd.Series:
            return texts.map(lambda x: None if x is None else [{"text": t, "open": o} for t, o in replaced(cut(x), words)])

        return of

    def normalised(self, text: Column) -> Column:
        """The text with variants replaced; only texts that mention one are handed to Python."""
        cut, words = self.cut(), dict(self.words)

        @F.pandas_udf("string")
        def of(texts: pd.Series) -> pd.Series:
            return texts.map(lambda x: None if x is None else "".join(t for t, _ in replaced(cut(x), words)))

        return F.coalesce(of(F.when(tx.mentions(text, list(words)), text)), text)


#: The variants that the engine knows by default.
VARIANT_LEXICON = Lexicon.of(dict(entries()))


def replace_in_text(canonical: DataFrame, lexicon: Lexicon) -> DataFrame:
    """seq and normalized.  Greedy replacement is sequential inside a text, so it is an Arrow kernel; the dictionary travels with it."""
    return canonical.select("seq", lexicon.normalised(F.col("canonical")).alias("normalized"))


def key_map(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """key and term for terms of two to four CJK characters that alone have their key; keys: token, key (a table of how tokens sound)."""
    return unambiguous_keys(terms.filter(tx.is_term(F.col("term"))).join(keys.withColumnRenamed("token", "term"), "term").select("term", "key"))


def trusted_since(canonical: DataFrame, terms: DataFrame, count: int) -> DataFrame:
    """term and since, the message at which a dictionary term had been seen count times as a canonical text."""
    of_term = canonical.join(terms.select(F.col("term").alias("canonical")).distinct(), "canonical", "left_semi")
    rank = F.row_number().over(Window.partitionBy("canonical").orderBy("seq"))
    return of_term.select("canonical", "seq", rank.alias("rank")).filter(F.col("rank") == count).select(F.col("canonical").alias("term"), F.col("seq").alias("since"))


def homophones(texts: DataFrame, lexicon: Lexicon, keys: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """cleaned and normalized for texts (cleaned, first_seq) in which a token becomes the one dictionary term that sounds alike.

    A token of two to four CJK characters that the dictionary has not is joined with the keys, its key with the key
    map, and the term with trusted (term, since): it counts from the message after ``since``.  Without trusted every
    term counts."""
    terms = texts.sparkSession.createDataFrame([(c,) for c in sorted({c for _, c in lexicon.words})], "term string")
    held = texts.filter(F.col("cleaned").rlike("[\\u4e00-\\u9fff]{2}")).withColumn("pieces", lexicon.pieces()(F.col("cleaned")))
    tokens = held.select("cleaned", "first_seq", F.posexplode("pieces").alias("pos", "piece"))
    asked = tokens.filter(F.col("piece.open") & tx.is_term(F.col("piece.text"))).select("cleaned", "first_seq", "pos", F.col("piece.text").alias("token"))
    like = asked.join(keys, "token").join(key_map(terms, keys), "key").filter("term <> token")
    if trusted is not None:
        like = like.join(trusted, "term").filter("since < first_seq")
    found = like.groupBy("cleaned").agg(F.map_from_entries(F.collect_set(F.struct("pos", "term"))).alias("like"))
    piece = lambda p, i: F.coalesce(F.col("like")[i], p["text"])
    return held.join(found, "cleaned").select("cleaned", F.array_join(F.transform("pieces", piece), "").alias("normalized"))


def unambiguous_keys(terms: DataFrame) -> DataFrame:
    """key and term for keys that exactly one term has; terms: term, key."""
    return terms.distinct().groupBy("key").agg(F.count("*").alias("n"), F.min("term").alias("term")).filter("n = 1").select("key", "term")


def training_pairs(spark: SparkSession) -> DataFrame:
    """Each variant with its canonical, and each canonical with itself."""
    listed = [(v, c) for c, vs in VARIANTS.items() for v in vs] + [(c, c) for c in VARIANTS]
    return spark.createDataFrame(listed, "variant string, canonical string").distinct()
