"""SimHash of short texts over character n-grams with a reproducible token hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SimhashSettings
from ..functions import text as tx


#: A counter has 7 bits in the topmost byte.
_COUNTED = 127


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


#: The bits of each byte value, each in a byte of its own: added up, eight counters in one number.
_SPREAD = [sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)]


def fingerprint(text: Column, ngram: int = 3) -> Column:
    """64 votes: a bit is set if more n-grams have it than have it not."""
    hashes = F.transform(tx.ngrams(text, ngram), tx.token_hash)
    shift = lambda x, by: F.call_function("shiftrightunsigned", x, by)
    every = F.sequence(F.lit(0), F.lit(63))

    def joined(votes, n: Column) -> Column:
        bit = lambda i: F.when(2 * votes(i) > n, F.call_function("shiftleft", _long(1), i)).otherwise(_long(0))
        return F.aggregate(every, _long(0), lambda s, i: s.bitwiseOR(bit(i)))

    def packed(h: Column) -> Column:
        none = F.struct(*(_long(0).alias(f"c{j}") for j in range(8)))
        byte = lambda x, j: (F.shiftrightunsigned(x, 8 * j).bitwiseAND(_long(255)) + 1).cast("int")
        add = lambda of: lambda s, x: F.struct(*((s[f"c{j}"] + F.element_at(of, byte(x, j))).alias(f"c{j}") for j in range(8)))
        together = lambda s: F.array(*(s[f"c{j}"] for j in range(8)))
        sums = F.transform(F.array(F.array(*map(_long, _SPREAD))), lambda of: F.aggregate(h, none, add(of), together))
        votes = lambda c, i: shift(F.element_at(c, (F.floor(i / 8) + 1).cast("int")), 8 * (i % 8)).bitwiseAND(_long(255))
        return F.transform(sums, lambda c: joined(lambda i: votes(c, i), F.size(h)))[0]

    def plain(h: Column) -> Column:
        return joined(lambda i: F.aggregate(h, F.lit(0), lambda s, x: s + F.getbit(x, i).cast("int")), F.size(h))

    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) <= _COUNTED, packed(h)).otherwise(plain(h)))[0]


def fingerprints(texts: DataFrame, settings: SimhashSettings = SimhashSettings()) -> DataFrame:
    """texts (canonical, first_seq, n) with fp."""
    return tx.once(tx.dealt(texts), "fp", fingerprint(F.col("canonical"), settings.ngram))


def merge_equal(prints: DataFrame, settings: SimhashSettings = SimhashSettings(), *more: str) -> DataFrame:
    """canonical, merged and more columns: texts long enough with one fingerprint become the one that was seen first."""
    long_enough = F.length("canonical") >= settings.min_length
    same = Window.partitionBy(F.when(long_enough, F.col("fp")).otherwise(F.xxhash64("canonical")), long_enough, F.when(~long_enough, F.col("canonical"))).orderBy("first_seq", "canonical")
    return prints.select("canonical", F.first("canonical").over(same).alias("merged"), *more)


def bands(fp: Column, n: int) -> Column:
    """(band, value) for n bands of 64 / n bits."""
    width = 64 // n
    value = lambda i: fp if n == 1 else F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.array(*(F.struct(F.lit(i).alias("band"), value(i).alias("value")) for i in range(n)))


def near_pairs(prints: DataFrame, distance: int | None = None, settings: SimhashSettings = SimhashSettings()) -> DataFrame:
    """Pairs of texts that are long enough and differ in at most distance bits: canonical_a first seen before canonical_b.

    With distance + 1 bands two such fingerprints agree in one whole band, so an equi-join on bands finds all of
    them; a pair is kept in the first band it shares, which spares a distinct over pairs.
    """
    distance = settings.candidate_distance if distance is None else distance
    n = next(k for k in (1, 2, 4, 8, 16, 32, 64) if k > distance)
    posted = prints.filter(F.length("canonical") >= settings.min_length).select("canonical", "first_seq", "fp", F.explode(bands(F.col("fp"), n)).alias("b")).select("canonical", "first_seq", "fp", "b.band", "b.value")
    a, b = (posted.select(*(F.col(c).alias(f"{c}_{s}") if c not in ("band", "value") else F.col(c) for c in posted.columns)) for s in ("a", "b"))
    met = a.join(b, ["band", "value"]).filter((F.col("first_seq_a") < F.col("first_seq_b")) | ((F.col("first_seq_a") == F.col("first_seq_b")) & (F.col("canonical_a") < F.col("canonical_b"))))
    differ = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = F.array_position(F.transform(bands(differ, n), lambda x: x["value"] == 0), True) - 1
    found = met.filter((F.bit_count(differ) <= distance) & (first == F.col("band")))
    return found.select("canonical_a", "canonical_b", F.bit_count(differ).cast("long").alias("distance"), F.when(F.bit_count(differ) <= settings.auto_distance, "auto").otherwise("candidate").alias("kind"))


def stage_distances(canonical: DataFrame) -> DataFrame:
    """How many different cleaned texts lie at each Hamming distance from what cycle compression makes of them."""
    once = canonical.select("cleaned", "canonical").distinct()
    apart = once.select(tx.hamming(fingerprint(F.col("cleaned")), fingerprint(F.col("canonical"))).cast("long").alias("distance"))
    return apart.groupBy("distance").agg(F.count("*").alias("n"))


def nearest_canonical(prints: DataFrame, settings: SimhashSettings = SimhashSettings()) -> DataFrame:
    """canonical, nearest, distance and kind for texts that have another one within the candidate distance before them.

    The nearest one is that of the least distance, the first seen at ties.  Within the automatic distance it takes the
    text over ("merge"), or gives way if it is the rarer one ("replace"); farther ones are only told ("candidate")."""
    pairs = near_pairs(prints, settings=settings).join(prints.select(F.col("canonical").alias("canonical_a"), F.col("first_seq").alias("seq_a")), "canonical_a")
    best = pairs.groupBy(F.col("canonical_b").alias("canonical")).agg(F.min(F.struct("distance", "seq_a", F.col("canonical_a").alias("nearest"))).alias("best"))
    count = prints.select("canonical", "n")
    met = best.join(count, "canonical").join(count.select(F.col("canonical").alias("nearest"), F.col("n").alias("n_nearest")), F.col("best.nearest") == F.col("nearest"))
    kind = F.when(F.col("best.distance") > settings.auto_distance, "candidate").when(F.col("n_nearest") < F.col("n"), "replace").otherwise("merge")
    return met.select("canonical", "nearest", F.col("best.distance").alias("distance"), kind.alias("kind"))
