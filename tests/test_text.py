"""Golden rows and properties of the text functions."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.config import Settings
from tidepool.functions import text as tx
from tidepool.operators import dictionary
from tidepool.operators.leader import penalty
from tidepool.sources import dictionaries


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


CLEANSE = [
    (None, None), ("", None), ("   ", None), ("１２３４５", None), ("12345", None), ("①②③④⑤", None), ("666", "666"), ("1234", "1234"),
    ("ＡＢＣ　ｄ", "ABC d"), ("a\t\n b", "a b"), ("x\u0007y", "xy"), ("x​y", "xy"), ("👨‍👩", "👨👩"), ("a" * 128, "a" * 128), ("a" * 129, None),
]
CYCLES = [("哈哈哈哈哈哈", "哈"), ("加油加油加油加", "加油加"), ("🎶🎤🐛🎶🎤🐛🎶🎤🐛", "🎶🎤🐛"), ("aaabbb", "ab"), ("abab", "abab"), ("2333", "23"), ("aaababab", "ababab")]


def test_cleanse_golden(spark):
    assert column(spark, [a for a, _ in CLEANSE], tx.cleanse) == [b for _, b in CLEANSE]


def test_cycle_golden(spark):
    assert column(spark, [a for a, _ in CYCLES], tx.compress_cycle) == [b for _, b in CYCLES]


def plain_cleanse(t):
    t = "".join(c for c in t if unicodedata.category(c)[0] != "C" or c in "\n\r\t")
    t = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip()
    return None if not t or re.fullmatch(r"\d{5,}", t) or len(t) > 128 else t


#: Characters that the Unicode tables of Java and Python both know.
OLD = st.characters(max_codepoint=0x7FF, blacklist_categories=["Cn"]) | st.characters(min_codepoint=0x4E00, max_codepoint=0x9FA5) | st.sampled_from("ｱＡ①㍿　\ufeff😀👍")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=OLD, max_size=30) | st.text(alphabet="ab 哈①１\n\t", max_size=40), min_size=40, max_size=60))
def test_stages_against_python(spark, values):
    values = [v.replace("\x00", "") for v in values]
    # Python counts the separators U+001C to U+001F as white space, but they are control characters and go before
    cleaned = column(spark, values, tx.cleanse)
    assert cleaned == [plain_cleanse(v) for v in values]
    again = column(spark, cleaned, tx.cleanse)
    assert all(a == b or b is None for a, b in zip(cleaned, again, strict=True))
    assert column(spark, cleaned, tx.compress_cycle) == [None if c is None else re.sub(r"(.+?)\1{2,}", r"\1", c) for c in cleaned]


def test_hashes_and_ngrams(spark):
    assert column(spark, ["abc"], lambda t: tx.hex16(tx.token_hash(t))) == ["d6963f7d28e17f72"]
    assert column(spark, ["哈", "好帅", "abcd"], tx.ngrams) == [["哈"], ["好帅"], ["abc", "bcd"]]


def test_penalty_and_jaccard(spark):
    pairs = [(3, 3, 1.0), (3, 2, 1.0), (6, 2, 0.9), (7, 2, 0.8), (0, 1, 1.0)]
    rows = spark.createDataFrame(pairs, "a int, b int, p double")
    assert all(r.q == r.p == penalty(r.a, r.b) for r in rows.select("*", tx.length_penalty(F.col("a"), F.col("b")).alias("q")).collect())
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.j for r in sets.select(tx.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [pytest.approx(1 / 3), 0.0]


def test_dictionary_golden(spark):
    lexicon = dictionary.VARIANT_LEXICON
    cut, words = lexicon.cut(), dict(lexicon.words)
    go = lambda t: "".join(x for x, _ in dictionary.replaced(cut(t), words))
    texts = ["牛批", "nb", "NB", "yyds", "破防了", "hhhh", "??不是", "nbc", "主播nb啊", "none of them"]
    want = ["牛逼", "牛逼", "牛逼", "永远的神", "哭了", "哈哈哈", "??不是", "nbc", "主播牛逼啊", "none of them"]
    assert [go(x) for x in texts] == want
    assert column(spark, [*texts, None], lexicon.normalised) == [*want, None]
    # any segmenter will do
    assert column(spark, ["xnb"], dictionary.Lexicon(lexicon.words, lambda t: [t[:1], t[1:]]).normalised) == ["xnb"]  # no token by the usual rule
    assert dictionary.replaced(["灰", "泽", "满", "酱"], words) == [("主播", False)]


def test_homophones_need_a_key_a_term_and_trust(spark):
    keys = spark.createDataFrame([("佳油", "jia1you2"), ("加油", "jia1you2"), ("无底", "wu2di2"), ("无敌", "wu2di2"), ("吴迪", "wu2di2")], "token string, key string")
    lexicon = dictionary.Lexicon.of(dict(dictionaries.entries()), lambda t: [t[i : i + 2] for i in range(0, len(t), 2)])
    texts = spark.createDataFrame([("佳油", 5), ("佳油吴迪", 6), ("ab佳油", 7), ("佳油", 8)], "cleaned string, first_seq long").dropDuplicates(["cleaned"])
    got = {r.cleaned: r.normalized for r in dictionary.homophones(texts, lexicon, keys).collect()}
    assert got == {"佳油": "加油", "佳油吴迪": "加油无敌", "ab佳油": "ab加油"}
    trusted = spark.createDataFrame([("加油", 5), ("无敌", 6)], "term string, since long")
    assert {r.cleaned: r.normalized for r in dictionary.homophones(texts.filter("first_seq > 5"), lexicon, keys, trusted).collect()} == {"佳油吴迪": "加油吴迪", "ab佳油": "ab加油"}
    # two terms that sound alike name none
    both = lexicon.words + (("x", "嘉游"),)
    more = keys.union(spark.createDataFrame([("嘉游", "jia1you2")], "token string, key string"))
    assert dictionary.homophones(texts, dictionary.Lexicon(both, lexicon.segmenter), more).filter("normalized like '%加油%'").isEmpty()


def test_settings_take_known_names_only():
    got = Settings().with_values({"cluster.max_slots": "7", "cleanse.max_length": "64"})
    assert (got.cluster.max_slots, got.cleanse.max_length) == (7, 64)
    with pytest.raises(KeyError):
        Settings().with_values({"cluster.slots": "7"})
    assert Settings.from_yaml("cluster:\n  max_slots: 9\nsimhash:\n  min_length: 4\n").cluster.max_slots == 9


def test_browser_profile(spark):
    table = spark.createDataFrame([(1, "XSWL"), (2, "other")], "seq long, canonical string")
    got = dictionary.replace_whole(table, dictionary.pairs(spark, dictionaries.WHOLE_TEXT)).collect()
    assert {r.seq: r.normalized for r in got} == {1: "笑死我了", 2: "other"}
    assert column(spark, ["x\u0007y", "12345", "１２３４５"], tx.cleanse_lite) == ["xy", None, "１２３４５"]


def test_cycles_of_every_length(spark):
    units = ["".join(chr(97 + (k * k + j) % 26) if k % 5 else "é" for k in range(j)) for j in (1, 2, 9, 10, 11, 20, 21, 22, 31, 32, 33, 41, 42, 43, 50)]
    said = [f"{head}{unit * times}{tail}" for unit in units for times in (2, 3, 4) for head in ("", "<") for tail in ("", ">>", "x" * 40)]
    assert column(spark, said, tx.compress_cycle) == [re.sub(r"(.+?)\1{2,}", r"\1", t) for t in said]


def test_words_are_mentioned_whole(spark):
    words = ["nb", "yyds", "666", "牛批", "绝绝子", "🐂a", "b🍺", "a.b"]
    said = [f"{a}{w}{b}" for w in words for a in ("", "x", "9", "啊", " ", "é") for b in ("", "x", "9", "啊", " ", "é")] + ["", "n b", "牛", "axb"]
    latin = "0-9A-Za-z"
    ends = lambda c: c.isascii() and c.isalnum()
    naive = "|".join((f"(?<![{latin}])" if ends(w[0]) else "") + re.escape(w) + (f"(?![{latin}])" if ends(w[-1]) else "") for w in words)
    assert column(spark, said, lambda c: tx.mentions(c, words)) == [bool(re.search(naive, t)) for t in said]
    assert column(spark, ["nb"], lambda c: tx.mentions(c, [])) == [False]
