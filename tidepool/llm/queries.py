"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_counts
from .common import read_documents

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeated_words(spark, read_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    rules = quality_rules.learn_rules(docs, _labels(spark, sf_dir))
    return quality_rules.judge(docs, rules)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_documents(spark, sf_dir), _vocabulary(), limit=512)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, read_documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_items(spark, read_documents(spark, sf_dir), benchmark)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return quality_classifier.score(docs, quality_classifier.fit(docs, _labels(spark, sf_dir)))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.drop_repeated_bytes(spark, read_documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(spark, read_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), _vocabulary(), window=1024)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(spark, read_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_token_counts": op3_token_counts,
        "op4_license_scan": op4_license_scan,
        "op5_decontamination": op5_decontamination,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_packing": op9_packing,
        "op10_line_dedup": op10_line_dedup,
    }


OP1 = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
f as (select k, min(doc_id) as d from win group by k),
hit as (select win.doc_id, win.i from win join f using (k) where f.d < win.doc_id),
gone as (select distinct doc_id, i + j as i from hit, range(0, 13) r(j)),
p as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
q as (select p.doc_id, count(*) filter (where gone.i is not null) as n, string_agg(p.word, ' ' order by p.i) filter (where gone.i is null) as kept
      from p left join gone on p.doc_id = gone.doc_id and p.i = gone.i group by p.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join q on w.doc_id = q.doc_id"""

OP7 = r"""
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
c as (select doc_id, j, substr(x, 2000 * j + 1, 2098) as part, length(x) // 2 - 1000 * j as rest from (select doc_id, x, unnest(range(0, (length(x) // 2 + 999) // 1000)) as j from h)),
b as (select doc_id, 1000 * j + i as i, substr(part, 2 * i + 1, 2) as byte, case when i + 50 <= rest then substr(part, 2 * i + 1, 100) end as k
      from (select doc_id, j, part, rest, unnest(range(0, least(1000, rest))) as i from c)),
f as (select k, min(doc_id) as d from b where k is not null group by k),
s as (select b.doc_id, b.i, b.byte, coalesce(f.d < b.doc_id, false) as hit from b left join f using (k)),
g as (select doc_id, i, byte, max(hit) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from s),
e as (select *, gone and not lag(gone, 1, false) over (partition by doc_id order by i) as opens from g),
q as (select doc_id, count(*) filter (where gone) as n, count(*) filter (where opens) as spans, string_agg(byte, '' order by i) filter (where not gone) as kept from e group by doc_id)
select h.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from h left join q on h.doc_id = q.doc_id"""


def _op4() -> str:
    """Every alignment of every template with every file, without an index."""
    quoted = lambda x: "'" + str(x) + "'"
    posted, phrases = [], []
    for t, (label, wording, key) in enumerate(license_scan.TEMPLATES):
        words, keys = wording.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(keys)] == keys)
        posted += [f"({quoted(w)}, {t}, {i}, {int(at <= i < at + len(keys))}, {quoted(label)})" for i, w in enumerate(words) if w not in license_scan.STOP or at <= i < at + len(keys)]
    for phrase, label in license_scan.BASE.items():
        phrases += [f"({quoted(label)}, {quoted(phrase)}, {len(phrase.split())})"]
    return rf"""
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{license_scan.CAPITALS}', '{license_scan.LOWER}'), '{license_scan.BETWEEN}'), lambda x: x <> '') as ws from documents),
p as (select * from (values {", ".join(posted)}) v(word, template, place, mandatory, label)),
ph as (select * from (values {", ".join(phrases)}) v(label, phrase, size)),
x as (select r, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from d),
h as (select x.* from x where word in (select word from p)),
f as (select p.word, ln(((select count(*) from d) + 1.0) / (count(distinct h.r) + 0.5)) as idf from (select distinct word from p) p left join h on h.word = p.word group by p.word),
wp as (select p.*, f.idf from p join f on f.word = p.word),
wh as (select template, sum(idf) as whole, sum(mandatory) as n_mandatory from wp group by template),
al as (select h.r, wp.template, h.i - wp.place as shift, any_value(wp.label) as label, sum(wp.idf) as matched, sum(wp.mandatory) as keys from h join wp on wp.word = h.word group by h.r, wp.template, h.i - wp.place),
kp as (select al.r, al.label, round(matched / whole, 6) as share from al join wh on wh.template = al.template where keys = n_mandatory and round(matched / whole, 6) >= 0.6),
b as (select d.r, x.i, ph.label from d join x on x.r = d.r join ph on x.word = string_split(ph.phrase, ' ')[1] where array_to_string(d.ws[x.i + 1:x.i + ph.size], ' ') = ph.phrase),
bs as (select r, count(*) as n, min(i) as first_word, max(i) as last_word, list_sort(list(distinct label)) as labels from b group by r),
ks as (select r, list(distinct label) as labels, max(share) as share from kp group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(bs.n, 0)::bigint as n_base, bs.first_word::bigint as first_word, bs.last_word::bigint as last_word, coalesce(array_to_string(bs.labels, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ks.labels, [])))), ','), '') as labels,
  case when bs.n > 0 then 1.0 else least(1.0, coalesce(ks.share, 0.0)) end::double as score
from d left join bs on bs.r = d.r left join ks on ks.r = d.r"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express: no XXH64, tokenizer, learned model or greedy template is among it."""
    return {"op1_substring_dedup": OP1, "op4_license_scan": _op4(), "op7_suffix_array_dedup": OP7}
