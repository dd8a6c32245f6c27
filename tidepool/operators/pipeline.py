"""From messages to canonical texts: cleanse, dictionary, cycle compression, SimHash merge.

Cleansing, dictionary and compression are columns and hold for batches and streams alike.  Homophones need to know
which terms were trusted when a text was first seen, and the SimHash merge which text was first: both are joins on
the different texts of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions import text as tx
from . import dictionary, simhash
from .dictionary import VARIANT_LEXICON, Lexicon


def cleansed(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All messages, with ``cleaned`` (null if dropped) and ``filtered``."""
    out = tx.once(messages, "visible", tx.visible(F.col("raw_text"))).withColumn("folded", tx.nfkc(F.col("visible")))
    out = tx.once(out, "cleaned", tx.accept(tx.squeeze(F.col("folded")), settings.cleanse)).drop("visible", "folded")
    return out.withColumn("filtered", F.col("cleaned").isNull())


def kept(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The messages that cleansing keeps."""
    return cleansed(messages, settings).filter(~F.col("filtered")).drop("filtered")


def compressed(messages: DataFrame, settings: Settings = Settings(), lexicon: Lexicon = VARIANT_LEXICON) -> DataFrame:
    """Kept messages with ``normalized`` and ``compressed``, without what depends on other messages."""
    normalised = kept(messages, settings).withColumn("normalized", lexicon.normalised(F.col("cleaned")))
    return _compressed(normalised)


def _compressed(normalised: DataFrame) -> DataFrame:
    """Cycles are compressed once: a second pass could change the text again."""
    return tx.once(normalised, "compressed", tx.compress_cycle(F.col("normalized")))


def stateless(messages: DataFrame, settings: Settings = Settings(), lexicon: Lexicon = VARIANT_LEXICON) -> DataFrame:
    """Messages with ``canonical`` by the stages that look at one message alone: what a stream can do."""
    return compressed(messages, settings, lexicon).withColumn("canonical", F.col("compressed"))


def sounded(messages: DataFrame, settings: Settings, lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """``compressed`` with tokens that sound like a trusted term replaced; a text keeps what it became when it was first seen.

    A term is trusted once enough messages before are that term without a homophone's help."""
    plain = compressed(messages, settings, lexicon)
    terms = messages.sparkSession.createDataFrame([(c,) for c in sorted({c for _, c in lexicon.words})], "term string")
    trusted = dictionary.trusted_since(plain.select(F.col("compressed").alias("canonical"), "seq"), terms, settings.cache.trusted_count)
    texts = plain.groupBy("cleaned").agg(F.min("seq").alias("first_seq"))
    changed = dictionary.homophones(texts, lexicon, keys, trusted).withColumnRenamed("normalized", "sounded")
    met = plain.drop("compressed").join(changed, "cleaned", "left").withColumn("normalized", F.coalesce("sounded", "normalized")).drop("sounded")
    return _compressed(met)


def merges(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """compressed and merged for texts that another text with the same fingerprint came before; texts: compressed, first_seq."""
    long_enough = texts.filter(F.length("compressed") >= settings.simhash.min_length).withColumnRenamed("compressed", "canonical")
    prints = simhash.fingerprints(long_enough, settings.simhash)
    first = F.first("canonical").over(Window.partitionBy("fp").orderBy("first_seq", "canonical"))
    return prints.withColumn("merged", first).filter("canonical <> merged").select(F.col("canonical").alias("compressed"), "merged")


def canonical(messages: DataFrame, settings: Settings = Settings(), lexicon: Lexicon = VARIANT_LEXICON, keys: DataFrame | None = None) -> DataFrame:
    """Kept messages with the text of every stage: cleaned, normalized, compressed and ``canonical``.

    keys (token, key) says how tokens sound; without it no homophones are replaced."""
    found = compressed(messages, settings, lexicon) if keys is None else sounded(messages, settings, lexicon, keys)
    texts = found.groupBy("compressed").agg(F.min("seq").alias("first_seq"))
    met = found.join(merges(texts, settings), "compressed", "left")
    return met.withColumn("canonical", F.coalesce("merged", "compressed")).drop("merged")


def counted(messages: DataFrame, settings: Settings = Settings(), lexicon: Lexicon = VARIANT_LEXICON) -> DataFrame:
    """canonical, n, first_seq, last_seq: the registry of ``canonical``, merged text by text and not message by message."""
    texts = compressed(messages, settings, lexicon).groupBy("compressed").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    prints = simhash.fingerprints(texts.withColumnRenamed("compressed", "canonical"), settings.simhash)
    merged = simhash.merge_equal(prints, settings.simhash, "n", "first_seq", "last_seq")
    return merged.groupBy(F.col("merged").alias("canonical")).agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def stage_changes(messages: DataFrame, settings: Settings = Settings(), lexicon: Lexicon = VARIANT_LEXICON) -> DataFrame:
    """How many messages each stage drops or changes."""
    total = messages.agg(F.count("*").alias("n_messages"))
    count = lambda a, b: F.coalesce(F.sum((F.col(a) != F.col(b)).cast("long")), F.lit(0).cast("long"))
    changed = canonical(messages, settings, lexicon).agg(
        F.count("*").alias("n_kept"),
        count("raw_text", "cleaned").alias("cleanse_changed"),
        count("cleaned", "normalized").alias("dictionary_changed"),
        count("normalized", "compressed").alias("cycle_changed"),
        count("compressed", "canonical").alias("simhash_merged"),
    )
    return total.join(changed).select("n_messages", (F.col("n_messages") - F.col("n_kept")).alias("n_filtered"), "cleanse_changed", "dictionary_changed", "cycle_changed", "simhash_merged")
