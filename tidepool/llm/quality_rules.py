"""Quality rules: statistics of a text and a decision list learned from labelled ones.

Everything that reads texts is made of DataFrame functions.  The list is learned from a bounded sample
of labelled statistics (``sample_rows`` rows, those with the least hash of doc_id, a few numbers each):
sequential covering grows one conjunction of thresholds at a time on two thirds of the sample, prunes it
on the other third, and sets what it covers aside.  The list becomes one ordered Spark conditional.

Defined cases: null and empty texts have zero statistics and fail the base rule (no 50 words).  Labels
that are null or name no document are not used; a document with several labels counts as good if their
mean is at least 1/2.  Without labels of both kinds the list is empty and keeps whatever the base rule
keeps.  Rows with equal doc_id are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of

SYMBOLS = "#*$%&|<>"
_BETWEEN_WORDS = " \t\n\u000b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _bound(value: Column, body) -> Column:
    """body(x) with x bound to value, which is then computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


#: So many different repeated windows are looked for one by one; more are told by their order.
_FEW = 64


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.  Windows are told apart by a 64-bit hash."""

    def words_in(at: Column) -> Column:
        """Words that lie in windows at these places, which are in order."""
        steps = lambda p: F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
        return _bound(at, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))

    def looked_for(windows: Column, twins: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(windows) - 1)
        return words_in(F.filter(places, lambda i: F.array_contains(twins, F.get(windows, i))))

    def ordered(windows: Column) -> Column:
        def marked(ordered: Column) -> Column:
            last = F.size(ordered) - 1
            twin = lambda e, k: (F.when(k > 0, ordered[k - 1]["h"] == e["h"]).otherwise(False)) | (F.when(k < last, ordered[k + 1]["h"] == e["h"]).otherwise(False))
            at = F.transform(F.filter(F.transform(ordered, lambda e, k: F.struct(e["at"].alias("at"), twin(e, k).alias("twin"))), lambda e: e["twin"]), lambda e: e["at"])
            return words_in(F.sort_array(at))

        return _bound(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), marked)

    def covered(windows: Column) -> Column:
        again = lambda x: F.array_distinct(F.filter(x, lambda h, k: F.when(k > 0, F.get(x, k - 1) == h).otherwise(False)))
        twins = _bound(F.sort_array(windows), again)
        told = _bound(twins, lambda t: F.when(F.size(t) <= _FEW, looked_for(windows, t)).otherwise(ordered(windows)))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(told)

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))
        return F.when(F.size(h) < 3, F.lit(0)).otherwise(_bound(windows, covered))

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BETWEEN_WORDS, "")) > 0)
    return _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text, as longs."""
    text = F.col("text")
    of_words = _bound(F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), ""), lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    found = texts_of(docs).select(
        "doc_id",
        of_words.alias("of_words"),
        F.length(F.translate(text, _BETWEEN_WORDS, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        _duplicate_lines(text).cast("long").alias("n_dup_lines"),
        _count_of(text, UPPER).cast("long").alias("n_upper"),
        _count_of(text, "!").cast("long").alias("n_bangs"),
    )
    return found.select(
        "doc_id",
        F.col("of_words.n_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("of_words.n_repeat_words").cast("long").alias("n_repeat_words"),
        "n_upper",
        "n_bangs",
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


#: What rules may test, by name.
FEATURES: dict[str, tuple[str, str] | None] = {
    "n_words": None,
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "bangs_per_word": ("n_bangs", "n_words"),
}


def feature(name: str) -> Column:
    parts = FEATURES[name]
    return _ratio(*parts) if parts else F.col(name).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _best_condition(rows: list[dict], cuts: int) -> Condition | None:
    """The threshold of greatest information gain for bad rows among all features."""
    bad = sum(r["bad"] for r in rows)
    if not bad or bad == len(rows):
        return None
    start, best, found = log2(bad / len(rows)), 1e-9, None
    for name in FEATURES:
        ordered = sorted((r[name], r["bad"]) for r in rows)
        values = [v for v, _ in ordered]
        sums = [0]
        for _, b in ordered:
            sums.append(sums[-1] + b)
        distinct = sorted(set(values))
        step = max(1, len(distinct) // cuts)
        for low, high in list(zip(distinct, distinct[1:], strict=False))[::step]:
            threshold = (low + high) / 2
            k = bisect_right(values, threshold)
            for above, p, n in ((False, sums[k], k), (True, bad - sums[k], len(rows) - k)):
                if p and (gain := p * (log2(p / n) - start)) > best:
                    best, found = gain, Condition(name, above, threshold)
    return found


def _worth(rule: Rule, rows: list[dict]) -> float:
    """(bad - good) / (bad + good) among what the rule covers, with one of either kind added."""
    got = _covered(rule, rows)
    bad = sum(r["bad"] for r in got)
    return (2 * bad - len(got)) / (len(got) + 2)


def learn(rows: list[dict], max_rules: int = 12, max_conditions: int = 4, cuts: int = 64, least_precision: float = 0.8) -> list[Rule]:
    """An ordered list of conjunctions that mark bad texts; rows hold the features, bad (0 or 1) and prune (in the third that prunes)."""
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules and any(r["bad"] for r in left):
        grow, prune = [r for r in left if not r["prune"]], [r for r in left if r["prune"]]
        rule: Rule = ()
        while len(rule) < max_conditions and (more := _best_condition(_covered(rule, grow), cuts)):
            rule += (more,)
        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda x: (_worth(x, prune), -len(x)))
        got = _covered(rule, left)
        bad = sum(r["bad"] for r in got)
        if bad < 3 or bad < least_precision * len(got):
            break
        rules.append(rule)
        taken = set(map(id, got))
        left = [r for r in left if id(r) not in taken]
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, seed: int = 1) -> list[dict]:
    """Statistics of at most sample_rows labelled documents, chosen by a hash of doc_id."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("mean_quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(sample_rows)
        .select(F.col("doc_id").alias("labelled_id"), (F.col("mean_quality") < 0.5).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)) == 0).alias("prune"))
    )
    of_these = texts_of(docs).join(F.broadcast(chosen.select("labelled_id")), F.col("doc_id") == F.col("labelled_id"), "left_semi")
    found = text_statistics(of_these).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    # rows with an equal doc_id could pass the bound: the one of the least statistics stands for all
    once = found.groupBy("labelled_id", "bad", "prune").agg(F.min(F.struct(*(feature(k).alias(k) for k in FEATURES))).alias("of"))
    return [r.asDict() for r in once.select("labelled_id", "bad", "prune", "of.*").orderBy("labelled_id").collect()]


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 5000) -> list[Rule]:
    return learn(labelled_sample(docs, labels, sample_rows))


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: false at the first rule that covers a row, else true."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The statistics of each row, base_failed and kept."""
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words"))
    return text_statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
