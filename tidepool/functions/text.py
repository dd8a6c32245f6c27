"""Column functions on message texts; all but Unicode compatibility folding run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CleanseSettings

#: Texts of these characters alone are their own NFKC form: ASCII and composed Latin letters.
_PLAIN = "^[\\x00-\\x7F\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E]*$"

# Multi-character stop words (single characters are no keywords anyway).
STOP_WORDS = ("什么", "怎么", "为什么")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """NFKC form; only texts that may change are handed to Python."""
    return F.coalesce(_nfkc(F.when(~text.rlike(_PLAIN), text)), text)


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, and none is left at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def visible(text: Column) -> Column:
    """The text without control, format, unassigned and private characters; line breaks and tabs stay."""
    return F.regexp_replace(text, "[\\p{C}&&[^\\n\\r\\t]]", "")


def once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """frame with a column that is computed once for a row, however many filters and projections use it.

    A generator of one row is what the optimizer neither repeats nor moves filters through.
    """
    return frame.select(*(c for c in frame.columns if c != name), F.explode(F.array(value)).alias(name))


def dealt(frame: DataFrame) -> DataFrame:
    """frame dealt to all cores, for costly expressions on few bytes, which adaptive execution would leave to one task."""
    spark = frame.sparkSession
    return frame.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def cleanse(text: Column, settings: CleanseSettings = CleanseSettings()) -> Column:
    """The cleaned text, or null for one that is dropped: empty, digit noise, or too short or long."""
    return accept(squeeze(nfkc(visible(text))), settings)


def accept(cleaned: Column, settings: CleanseSettings = CleanseSettings()) -> Column:
    def of(c: Column) -> Column:
        noise = c.rlike(f"^\\p{{Nd}}{{{settings.digit_noise},}}$")
        return F.when((c != "") & F.length(c).between(settings.min_length, settings.max_length) & ~noise, c)

    return F.transform(F.array(cleaned), of)[0]


def cleanse_lite(text: Column, settings: CleanseSettings = CleanseSettings()) -> Column:
    """The browser profile: C0 and C1 controls and ASCII digits only."""
    cleaned = squeeze(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", ""))
    noise = cleaned.rlike(f"^[0-9]{{{settings.digit_noise},}}$")
    return F.when((cleaned != "") & F.length(cleaned).between(settings.min_length, settings.max_length) & ~noise, cleaned)


def compress_cycle(text: Column) -> Column:
    """Three or more copies of a shortest period become one, once over the text from left to right."""
    out = F.regexp_replace(text, "(.+?)\\1{2,}", "$1")
    for longest in (128, 96, 64, 32):  # a period is a third of the text at most
        out = F.when(F.length(text) <= longest, F.regexp_replace(text, f"(.{{1,{longest // 3}}}?)\\1{{2,}}", "$1")).otherwise(out)
    return out


def is_term(text: Column) -> Column:
    """Two to four CJK characters."""
    return text.rlike("^[\\u4e00-\\u9fff]{2,4}$")


def ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams; a shorter text is its own only one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def token_hash(token: Column) -> Column:
    """The low 64 bits of the MD5, as a signed number."""
    return F.conv(F.substring(F.md5(token), 17, 16), 16, -10).cast("long")


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}_]+"), "")


def is_keyword(token: Column) -> Column:
    return (F.length(token) >= 2) & ~token.rlike("^\\p{Nd}+$") & ~token.isin(*STOP_WORDS)


def length_penalty(a: Column, b: Column) -> Column:
    """1, 0.9 or 0.8 as the lengths' ratio is up to 1.5, up to 3 or above."""
    ratio = F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1))
    return F.when(ratio <= 1.5, 1.0).when(ratio <= 3.0, 0.9).otherwise(0.8)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def heat_ratio(count: Column, most: Column) -> Column:
    return F.log10(1 + 9 * count / most)


def mentions(text: Column, words: list[str]) -> Column:
    """Whether the text may have one of the words as tokens: it holds the word, not inside a longer Latin run."""
    latin = "0-9A-Za-z"

    def bounded(w: str) -> str:
        tail = f"(?![{latin}])" if w[-1].isascii() and w[-1].isalnum() else ""
        return "\\Q" + w + "\\E" + tail

    def led(some: list[str], before: str = "") -> list[str]:
        """The words behind a look at their first characters, which most places fail at once."""
        heads = [f"\\x{{{ord(c):x}}}" for c in sorted({w[0] for w in some})]
        return [f"(?=[{heads[0]}-{heads[-1]}])(?=[{''.join(heads)}]){before}(?:{'|'.join(map(bounded, sorted(some)))})"] if some else []

    runs = [w for w in words if w[0].isascii() and w[0].isalnum()]
    rest = [w for w in words if not (w[0].isascii() and w[0].isalnum())]
    return text.rlike("|".join(led(runs, f"(?<![{latin}])") + led(rest))) if words else F.lit(False)
