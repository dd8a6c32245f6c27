"""The registry of canonical texts: counts, first and last occurrence, examples, members, ranks, prefixes.

Counts are commutative aggregates with partial sums.  What depends on order (first five examples, last
members) ranks inside each canonical first, so that no aggregate collects more than it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CacheSettings
from .ordered import count_before


def registry(canonical: DataFrame) -> DataFrame:
    """canonical, n, first_seq, last_seq."""
    return canonical.groupBy("canonical").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(values)), lambda x: x["raw_text"]), "|")


def first_examples(canonical: DataFrame, keep: int = 5) -> DataFrame:
    """canonical and its first raw texts in order, joined by |."""
    w = Window.partitionBy("canonical").orderBy("seq")
    first = canonical.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    return first.groupBy("canonical").agg(_joined(F.struct("seq", "raw_text")).alias("examples"))


def last_members(canonical: DataFrame, keep: int = 5) -> DataFrame:
    """canonical and its last members' raw texts in order, joined by |."""
    w = Window.partitionBy("canonical").orderBy(F.desc("seq"))
    last = canonical.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    return last.groupBy("canonical").agg(_joined(F.struct("seq", "raw_text")).alias("members"))


def distinct_raws(canonical: DataFrame, keep: int | None = 10) -> DataFrame:
    """canonical, how many different raw texts it has, and the first ``keep`` of them (all if None) in order of first sight, joined by |."""
    once = canonical.groupBy("canonical", "raw_text").agg(F.min("seq").alias("seq"))
    shown = F.struct("seq", "raw_text")
    if keep is None:
        return once.groupBy("canonical").agg(F.count("*").alias("n_raws"), _joined(shown).alias("raws"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("canonical").orderBy("seq")))
    first = ranked.filter(F.col("rank") <= keep).groupBy("canonical").agg(_joined(shown).alias("raws"))
    return once.groupBy("canonical").agg(F.count("*").alias("n_raws")).join(first, "canonical")


def dedup_rate(cleansed: DataFrame, canonical: DataFrame) -> DataFrame:
    """total (filtered messages count), kept, n_unique, dedup_rate of all and of the kept messages."""
    total = cleansed.agg(F.count("*").alias("total"))
    kept = canonical.groupBy("canonical").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_kept"), F.count("*").alias("n_unique"))
    rate = lambda n: F.when(F.col(n) > 0, F.round(1 - F.col("n_unique") / F.col(n), 6)).otherwise(0.0)
    return total.join(kept).select("total", "n_kept", "n_unique", rate("total").alias("dedup_rate"), rate("n_kept").alias("dedup_rate_kept"))


def frequency_rank(canonical: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent canonicals: rank, canonical, n, first_seq; ties by first occurrence."""
    leading = registry(canonical).orderBy(F.desc("n"), "first_seq").limit(top)
    return leading.select(F.row_number().over(Window.orderBy(F.desc("n"), "first_seq")).cast("long").alias("rank"), "canonical", "n", "first_seq")


def frequency_table(canonical: DataFrame) -> DataFrame:
    """canonical, n, first_seq and first_date of every canonical text."""
    return canonical.groupBy("canonical").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.date_format(F.min_by("ts", "seq"), "yyyy-MM-dd").alias("first_date"))


def layers(canonical: DataFrame) -> DataFrame:
    """seq and layer: 3 where a canonical occurs first, else 1.  A join, so that a very frequent canonical can be split."""
    first = canonical.groupBy("canonical").agg(F.min("seq").alias("first_seq"))
    return canonical.join(first, "canonical").select("seq", F.when(F.col("seq") == F.col("first_seq"), 3).otherwise(1).alias("layer"))


def running_trust(canonical: DataFrame, settings: CacheSettings = CacheSettings()) -> DataFrame:
    """seq, how often its canonical occurred before, and whether it was trusted by then."""
    counted = count_before(canonical.select("canonical", "seq"), "canonical", "seq", "n_before")
    return counted.select("seq", "n_before", (F.col("n_before") >= settings.trusted_count).alias("trusted"))


def cache_hit_stage(canonical: DataFrame) -> DataFrame:
    """seq and the first stage whose text an earlier message left in the cache: cleanse, normalize, cycle or none.

    A message leaves its cleaned, its normalized and its canonical text."""
    texts = canonical.select("seq", F.explode(F.array_distinct(F.array("cleaned", "normalized", "canonical"))).alias("text"))
    first = texts.groupBy("text").agg(F.min("seq").alias("first_seq"))
    known = canonical.select("seq", "cleaned", "normalized", "compressed")
    # a text that many messages share is a skewed key, which adaptive execution splits
    for stage in ("cleaned", "normalized", "compressed"):
        known = known.join(first.select(F.col("text").alias(stage), F.col("first_seq").alias(f"{stage}_first")), stage, "left")
    before = lambda stage: F.col(f"{stage}_first") < F.col("seq")
    return known.select("seq", F.when(before("cleaned"), "cleanse").when(before("normalized"), "normalize").when(before("compressed"), "cycle").otherwise("none").alias("stage"))


def liveness(accesses: DataFrame, key: str, ts: str, order: str, settings: CacheSettings = CacheSettings()) -> DataFrame:
    """order and alive: whether the key was used within the time to live before."""
    w = Window.partitionBy(key).orderBy(ts, order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(w))
    return accesses.select(order, F.coalesce(gap < F.lit(int(settings.ttl_seconds * 1_000_000)), F.lit(False)).alias("alive"))


def duplicate_rate(canonical: DataFrame) -> DataFrame:
    """n_messages, n_duplicates and their ratio: a message is a duplicate if its canonical occurred before."""
    got = registry(canonical).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_messages"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
    return got.withColumn("hit_rate", F.when(F.col("n_messages") > 0, F.round(F.col("n_duplicates") / F.col("n_messages"), 6)).otherwise(0.0))


def recent(canonical: DataFrame, keep: int = 200) -> DataFrame:
    """The last messages."""
    return canonical.orderBy(F.desc("seq")).limit(keep).select("seq", "raw_text", "canonical")


def heat(canonical: DataFrame) -> DataFrame:
    """canonical and its heat: the logarithm of its share of the greatest count."""
    counted = registry(canonical)
    most = counted.agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(most)).select("canonical", F.round(F.log10(1 + 9 * F.col("n") / F.col("most")), 6).alias("heat"))
