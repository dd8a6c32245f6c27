"""The same queries as SQL for DuckDB, over the tables by name."""

from __future__ import annotations

from ..operators.dictionary import VARIANTS
from ..sources import dictionaries

_LINES = """
m as (select doc_id * 268435456 + pos - 1 as seq, doc_id, lang as stream, line as raw from (
    select doc_id, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
c as (select seq, stream, raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as t from m),
k as (select seq, stream, raw, t as cleaned from c where t <> '' and length(t) between 1 and 128 and not regexp_full_match(t, '\\p{Nd}{5,}'))"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _dictionary(words: dict[str, str]) -> str:
    """Tokens by forward maximum match, then from left to right the longest join of up to four that the dictionary has."""
    vocabulary = "[" + ", ".join(map(_quoted, sorted({w for pair in words.items() for w in pair}))) + "]"
    variants = "[" + ", ".join(map(_quoted, words)) + "]"
    canonicals = "[" + ", ".join(map(_quoted, words.values())) + "]"
    return f"""
tk as (
  select distinct cleaned as t, 1 as i, []::varchar[] as toks from k
  union all
  select t, i + n, list_append(toks, substr(t, i::int, n::int)) from (select t, i, toks,
      case when regexp_matches(substr(t, i::int, 1), '[0-9A-Za-z]') then length(regexp_extract(substr(t, i::int), '^[0-9A-Za-z]+'))
        else greatest(1, coalesce(list_max(list_transform(list_filter({vocabulary}, lambda w: starts_with(substr(t, i::int), w)), lambda w: length(w))), 1)) end as n
    from tk where i <= length(t))),
rp as (
  select t, toks, 1 as i, ''::varchar as o from tk where i > length(t)
  union all
  select t, toks, i + n, o || coalesce({canonicals}[list_position({variants}, array_to_string(toks[i:i + n - 1], ''))], array_to_string(toks[i:i + n - 1], ''))
  from (select t, toks, i, o, coalesce(list_max(list_filter([1, 2, 3, 4], lambda x: i + x - 1 <= len(toks) and list_contains({variants}, array_to_string(toks[i:i + x - 1], '')))), 1) as n
    from rp where i <= len(toks))),
kn as (select k.*, rp.o as normalized from k join rp on k.cleaned = rp.t and rp.i > len(rp.toks))"""


# cycles: at position i the least period with three copies, then as many copies as there are
_CYCLES = """
f as (select distinct normalized as t from kn),
z as (
  select t, 1 as i, ''::varchar as o from f
  union all
  select t, i + adv, o || emit from (
    select z.t, z.i, z.o, coalesce((select min(p) from range(1, length(z.t) // 3 + 1) r(p)
        where substr(z.t, z.i::int, (3 * p)::int) = repeat(substr(z.t, z.i::int, p::int), 3)
          and length(substr(z.t, z.i::int, (3 * p)::int)) = 3 * p), 0) as p
    from z where z.i <= length(z.t)) x,
  lateral (select
      case when p = 0 then 1 else p * coalesce((select max(n) from range(3, length(x.t) + 1) g(n)
        where substr(x.t, x.i::int, (n * p)::int) = repeat(substr(x.t, x.i::int, p::int), n::int)
          and length(substr(x.t, x.i::int, (n * p)::int)) = n * p), 3) end as adv,
      case when p = 0 then substr(x.t, x.i::int, 1) else substr(x.t, x.i::int, p::int) end as emit) y),
y as (select t, o from z where i > length(t)),
r0 as (select kn.*, y.o as compressed from kn join y on kn.normalized = y.t),
g0 as (select compressed as canonical, count(*) as n, min(seq) as first_seq from r0 group by compressed)"""

_HASH = "concat('0x', substr(md5(g), 17, 16))::ubigint"


def _fingerprints(source: str, name: str) -> str:
    """{name}p: canonical, first_seq, n and fp of the texts of a table."""
    return f"""
{name}u as (select canonical, first_seq, n, unnest(list_transform(range(1, greatest(length(canonical) - 2, 1) + 1), lambda i: substr(canonical, i, 3))) as g from {source}),
{name}h as (select canonical, first_seq, n, {_HASH} as h from {name}u),
{name}b as (select canonical, first_seq, n, i, sum(case when (h >> i) & 1 = 1 then 1 else 0 end) * 2 > count(*) as bit from {name}h, range(0, 64) t(i) group by canonical, first_seq, n, i),
{name}p as (select canonical, first_seq, n, sum(case when bit then (1::hugeint << i::int) else 0 end)::ubigint as fp from {name}b group by canonical, first_seq, n)"""


_MERGED = f"""{_fingerprints("(select * from g0 where length(canonical) >= 8)", "t")},
mg as (select canonical, first_value(canonical) over (partition by fp order by first_seq, canonical) as merged from tp),
r as (select r0.*, coalesce(mg.merged, r0.compressed) as canonical from r0 left join mg on r0.compressed = mg.canonical),
g as (select canonical, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from r group by canonical)"""


def _stages(words: dict[str, str]) -> str:
    return f"{_LINES.strip()}, {_dictionary(words).strip()}, {_CYCLES.strip()}, {_MERGED.strip()}"


_ENGINE, _SAMPLE = dict(dictionaries.entries()), dict(dictionaries.entries()) | dictionaries.LATIN
_CANONICAL = _stages(_ENGINE)


def _lines(body: str) -> str:
    return f"with {_LINES.strip()}\n{body}"


def _canonical(body: str) -> str:
    return f"with recursive {_CANONICAL}\n{body}"


def _sample(body: str) -> str:
    return f"with recursive {_stages(_SAMPLE)}\n{body}"


def _values(rows: list[tuple[str, ...]], names: str) -> str:
    quoted = ", ".join("(" + ", ".join(_quoted(x) for x in row) + ")" for row in rows)
    return f"(values {quoted}) as v({names})"


def _prints(body: str) -> str:
    return f"with recursive {_CANONICAL}, {_fingerprints('g', '').strip()}\n{body}"


def _kprints(body: str) -> str:
    both = """
d as (select distinct cleaned, compressed as canonical from r),
w as (select cleaned as canonical, 0 as first_seq, 1 as n from d union select canonical, 0, 1 from d)"""
    return f"with recursive {_CANONICAL}, {both.strip()}, {_fingerprints('w', '').strip()}\n{body}"


_NEAR = (
    "select a.canonical as canonical_a, b.canonical as canonical_b, bit_count(xor(a.fp, b.fp))::bigint as distance, case when bit_count(xor(a.fp, b.fp)) <= 2 then 'auto' else 'candidate' end as kind, a.first_seq as seq_a, a.n as n_a, b.n as n_b "
    "from p a join p b on (a.first_seq < b.first_seq or (a.first_seq = b.first_seq and a.canonical < b.canonical)) "
    "where length(a.canonical) >= 8 and length(b.canonical) >= 8 and bit_count(xor(a.fp, b.fp)) <= 3"
)


_WORDS = """
q as (select seq, stream, unnest(list_filter(string_split_regex(lower(raw), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) as word,
        generate_subscripts(list_filter(string_split_regex(lower(raw), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''), 1) as pos from k),
e as (select seq, stream, word, count(*) as n, min(pos) as pos from q
      where length(word) >= 2 and not regexp_full_match(word, '\\p{Nd}+') group by seq, stream, word),
a as (select *, row_number() over (partition by seq, stream order by n desc, pos) as rank from e),
kw as (select seq, stream, list(word order by rank) as words from a where rank <= 5 group by seq, stream)"""


def _words(body: str) -> str:
    return f"with {_LINES.strip()}, {_WORDS.strip()}\n{body}"


_CENTROIDS = """
x as (select label, vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as v from embeddings),
me as (select label, pos, avg(v) as mean, count(*) as n from x group by label, pos),
un as (select label, pos, n, mean, mean / (sqrt(sum(mean * mean) over (partition by label)) + 1e-8) as unit from me)"""


def _centroids(body: str) -> str:
    return f"with {_CENTROIDS.strip()}\n{body}"


_PAIR = """
dots as (select a.label as a, b.label as b, sum(a.unit * b.unit) as s, max(a.n) as n_a, max(b.n) as n_b from un a join un b on a.pos = b.pos and a.label < b.label group by a.label, b.label),
mc as (select a, b, n_a, n_b, s from dots where round(s, 9) > 0)"""


#: What the golden messages become, by hand: cleaned, normalized, compressed; None where cleansing drops one.
GOLDEN_EXPECTED: list[tuple[str, str, str] | None] = [
    None, None, None, None, None, ("666", "666", "6"), ("1234",) * 3, ("ABC d",) * 3, ("a b",) * 3, ("xy",) * 3, ("xy",) * 3, ("👨👩",) * 3, None, ("哈哈哈哈哈哈", "哈哈哈哈哈哈", "哈"), ("加油加油加油加", "加油加油加油加", "加油加"),
    ("🎶🎤🐛🎶🎤🐛🎶🎤🐛", "🎶🎤🐛🎶🎤🐛🎶🎤🐛", "🎶🎤🐛"), ("aaabbb", "aaabbb", "ab"), ("abab",) * 3, ("2333", "2333", "23"), ("aaababab", "aaababab", "ababab"), ("牛批", "牛逼", "牛逼"), ("nb", "牛逼", "牛逼"), ("NB", "牛逼", "牛逼"),
    ("yyds", "永远的神", "永远的神"), ("破防了", "哭了", "哭了"), ("??不是",) * 3, ("hhhh", "哈哈哈", "哈"), ("nb nb nb", "牛逼 牛逼 牛逼", "牛逼 牛逼 牛逼"), ("nbc",) * 3, ("主播nb啊", "主播牛逼啊", "主播牛逼啊"),
]
#: What the messages with homophones become: a term counts from the message after its third one on, and a text keeps what it first became.
SOUNDED_EXPECTED = ["佳油", "加油", "加油", "佳油啊", "加油", "加油吧", "佳油", "加油主播", "煮播加油", "谢谢", "卸卸"]


def _golden() -> str:
    rows = ", ".join(f"({i}::bigint, " + ", ".join("null" if x is None else _quoted(x) for x in (row or (None,) * 3)) + ")" for i, row in enumerate(GOLDEN_EXPECTED))
    return f"select * from (values {rows}) as v(seq, cleaned, normalized, compressed)"


def oracle_sql() -> dict[str, str]:
    whole = list((dictionaries.WHOLE_TEXT | dictionaries.LATIN).items())
    pairs = [(v, c) for c, vs in VARIANTS.items() for v in vs] + [(c, c) for c in VARIANTS]
    listed = [(v, c, str(i)) for i, (v, c) in enumerate(dictionaries.entries())]
    from .queries import FEELINGS

    praise, blame = (", ".join(f"'{x}'" for x in xs) for xs in (dictionaries.PRAISE, dictionaries.BLAME))
    registry = "select canonical, n, first_seq, last_seq from g"
    return {
        "cleanse_messages": _lines("select seq, stream, cleaned from k"),
        "event_messages": _lines("select raw as raw_text, count(*) as n from m where seq % 3 <> 0 and raw <> '' group by raw"),
        "query_string_messages": _lines("select raw as raw_text, count(*) as n from m where raw <> '' group by raw"),
        "replay_csv_messages": _lines(
            "select trim(raw) as raw_text, doc_id * 1000 + (seq % 268435456) // 1000 as at_ms, strftime(make_timestamp(doc_id * 1000000 + seq % 268435456), '%Y-%m-%d') as date from m where trim(raw) <> ''"
        ),
        "text_file_messages": _lines("select trim(raw) as raw_text, count(*) as n from m where trim(raw) <> '' group by trim(raw)"),
        "cleanse_lite_messages": """
            select doc_id * 268435456 + pos - 1 as seq, t as cleaned from (
              select doc_id, pos, trim(regexp_replace(regexp_replace(line, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g'), '\\s+', ' ', 'g')) as t from (
                select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents))
            where t <> '' and length(t) <= 128 and not regexp_full_match(t, '[0-9]{5,}')""",
        "cleanse_filtered_split": _lines("select m.seq, k.seq is null as filtered, case when k.seq is null then 'filtered' else 'kept' end as part from m left join k on m.seq = k.seq"),
        "normalize_messages": _sample("select seq, cleaned, normalized, compressed from r"),
        "cycle_compress": _canonical("select distinct normalized, compressed from r"),
        "golden_stages": _golden(),
        "homophone_replace": f"select v.seq::bigint as seq, v.canonical from {_values([(str(i), t) for i, t in enumerate(SOUNDED_EXPECTED)], 'seq, canonical')}",
        "token_dictionary_replace": "with recursive "
        + _CANONICAL
        + ", "
        + _dictionary(_SAMPLE).strip().replace("tk as", "tk2 as").replace("from tk ", "from tk2 ").replace("rp as", "rp2 as").replace("from rp ", "from rp2 ").replace("select distinct cleaned as t, 1 as i, []::varchar[] as toks from k", "select distinct canonical as t, 1 as i, []::varchar[] as toks from r").replace("kn as (select k.*, rp.o as normalized from k join rp on k.cleaned = rp.t and rp.i > len(rp.toks))", "kn2 as (select r.seq, rp2.o as normalized from r join rp2 on r.canonical = rp2.t and rp2.i > len(rp2.toks))")
        + "\nselect seq, normalized from kn2",
        "stage_change_counts": _canonical(
            "select (select count(*) from m) as n_messages, (select count(*) from m) - count(*) as n_filtered, "
            "count(*) filter (where raw <> cleaned) as cleanse_changed, count(*) filter (where cleaned <> normalized) as dictionary_changed, "
            "count(*) filter (where normalized <> compressed) as cycle_changed, count(*) filter (where compressed <> canonical) as simhash_merged from r"
        ),
        "whole_text_variant": _canonical(f"select seq, coalesce(v.replacement, canonical) as normalized from r left join {_values(whole, 'variant, replacement')} on lower(canonical) = v.variant"),
        "unambiguous_key_map": """
            with t as (select distinct unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) as term from benchmark),
            s as (select term, regexp_replace(term, '[^a-z]|[aeiou]', '', 'g') as key from t where term <> '')
            select key, min(term) as term from s where key <> '' group by key having count(*) = 1""",
        "canonical_registry": _canonical(registry),
        "stream_registry_counts": _canonical(registry),
        "first_five_examples": _canonical("select canonical, string_agg(raw, '|' order by seq) as examples from (select *, row_number() over (partition by canonical order by seq) as rn from r) where rn <= 5 group by canonical"),
        "members_last_n": _canonical("select canonical, string_agg(raw, '|' order by seq) as members from (select *, row_number() over (partition by canonical order by seq desc) as rn from r) where rn <= 5 group by canonical"),
        "unique_and_dedup_rate": _canonical(
            "select (select count(*) from m) as total, sum(n)::bigint as n_kept, count(*) as n_unique, round(1 - count(*) / (select count(*) from m), 6) as dedup_rate, round(1 - count(*) / sum(n), 6) as dedup_rate_kept from g"
        ),
        "distinct_raws": _canonical(
            "select canonical, count(*) as n_raws, string_agg(raw, '|' order by seq) filter (where rn <= 10) as raws from ("
            "select canonical, raw, min(seq) as seq, row_number() over (partition by canonical order by min(seq)) as rn from r group by canonical, raw) group by canonical"
        ),
        "frequency_rank": _canonical("select row_number() over (order by n desc, first_seq) as rank, canonical, n, first_seq from g order by n desc, first_seq limit 20"),
        "first_seen_layer": _canonical("select seq, case when row_number() over (partition by canonical order by seq) = 1 then 3 else 1 end as layer from r"),
        "running_trust": _canonical("select seq, n_before, n_before >= 3 as trusted from (select seq, count(*) over (partition by canonical order by seq rows between unbounded preceding and 1 preceding) as n_before from r)"),
        "frequency_table": _canonical(
            "select canonical, count(*) as n, min(seq) as first_seq, strftime(make_timestamp((min(seq) // 268435456) * 1000000 + min(seq) % 268435456), '%Y-%m-%d') as first_date from r group by canonical"
        ),
        "cache_hit_stage": _sample(
            "select r.seq, case when a.s < r.seq then 'cleanse' when b.s < r.seq then 'normalize' when d.s < r.seq then 'cycle' else 'none' end as stage from r "
            + " ".join(
                f"left join (select t, min(seq) as s from (select cleaned as t, seq from r union all select normalized, seq from r union all select canonical, seq from r) group by t) {x} on {x}.t = r.{column}"
                for x, column in (("a", "cleaned"), ("b", "normalized"), ("d", "compressed"))
            )
        ),
        "cache_ttl_liveness": "select event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) < 600000000, false) as alive from events",
        "duplicate_hit_rate": _canonical("select sum(n)::bigint as n_messages, sum(n - 1)::bigint as n_duplicates, round(sum(n - 1) / sum(n), 6) as hit_rate from g"),
        "stage_latency_stats": """
            with l as (select *, row_number() over (partition by event_type order by event_id desc) as rn from events)
            select event_type, count(*) as n, round(avg(value), 6) as avg_ms, min(value) as min_ms, max(value) as max_ms, round(avg(value) filter (where rn <= 100), 6) as recent_ms from l group by event_type""",
        "stage_moving_mean": "select event_id, event_type, round(avg(value) over (partition by event_type order by event_id rows between 99 preceding and current row) + 1e-9, 6) as recent_ms from events",
        "replay_pacing": "select event_id, round((epoch_us(ts) - (select min(epoch_us(ts)) from events)) / 2e6, 3) as offset_s from events",
        "recent_log": _canonical("select seq, raw as raw_text, canonical from r order by seq desc limit 200"),
        "heat_ratio": _canonical("select canonical, round(log10(1 + 9 * n / (select max(n) from g)), 6) as heat from g"),
        "event_json_numbers": "select event_id, (props ->> '$.k')::bigint as k from events where (props ->> '$.k') is not null",
        "training_pairs": f"select distinct variant, canonical from {_values(pairs, 'variant, canonical')}",
        "variant_dictionary": f"select variant, max_by(canonical, ord::int) as canonical from {_values(listed, 'variant, canonical, ord')} group by variant",
        "simhash_fingerprint": _prints("select canonical, printf('%016x', fp) as fp from p"),
        "simhash_effective_merge": "with recursive "
        + _CANONICAL
        + ", "
        + _fingerprints("g0", "e").strip()
        + "\nselect canonical, case when length(canonical) >= 8 then first_value(canonical) over (partition by fp, length(canonical) >= 8 order by first_seq, canonical) else canonical end as merged from ep",
        "simhash_near_dup_pairs": _prints(f"select canonical_a, canonical_b, distance, kind from ({_NEAR})"),
        "simhash_kinds": _prints(f"select kind, count(*) as n from ({_NEAR}) group by kind"),
        "simhash_nearest_canonical": _prints(
            f"select canonical_b as canonical, canonical_a as nearest, distance, case when distance > 2 then 'candidate' when n_a < n_b then 'replace' else 'merge' end as kind from ("
            f"select *, row_number() over (partition by canonical_b order by distance, seq_a, canonical_a) as rn from ({_NEAR})) where rn = 1"
        ),
        "hamming_histogram": _kprints("select bit_count(xor(a.fp, b.fp))::bigint as distance, count(*) as n from d join p a on d.cleaned = a.canonical join p b on d.canonical = b.canonical group by 1"),
        "keyword_topk_per_message": _words("select seq, array_to_string(words, ',') as keywords from kw"),
        "keyword_signature": _words(
            "select stream, word, n, rank from (select stream, word, count(*) as n, row_number() over (partition by stream order by count(*) desc, word) as rank from (select stream, unnest(words) as word from kw) group by stream, word) where rank <= 5"
        ),
        "keyword_jaccard_pairs": _words(
            "select seq, round(len(list_intersect(words, prev)) / len(list_distinct(list_concat(words, prev))), 6) as jaccard from (select seq, words, lag(words) over (partition by stream order by seq) as prev from kw) where prev is not null"
        ),
        "length_penalty_pairs": _canonical(
            "select seq, case when q <= 1.5 then 1.0 when q <= 3 then 0.9 else 0.8 end::double as penalty from (select seq, greatest(a, b) / greatest(least(a, b), 1) as q from ("
            "select seq, length(canonical) as a, lag(length(canonical)) over (partition by stream order by seq) as b from r) where b is not null)"
        ),
        "neighbour_admission": _canonical("").rstrip()
        + ", "
        + _WORDS.strip()
        + """,
            sd as (select r.seq, r.stream, r.canonical as t, list_distinct(list_transform(range(1, greatest(length(r.canonical) - 2, 1) + 1), lambda i: substr(r.canonical, i, 3))) as grams, coalesce(kw.words, []) as words
                from r left join kw on kw.seq = r.seq),
            pv as (select *, lag(struct_pack(t, grams, words)) over (partition by stream order by seq) as p from sd),
            sc as (select seq, round(len(list_intersect(grams, p.grams)) / len(list_distinct(list_concat(grams, p.grams))), 6) as s, words, p.words as pw, length(t) as la, length(p.t) as lb from pv where p is not null),
            fx as (select *, case when len(words) > 0 and len(pw) > 0 then 0.7::double * s + (1 - 0.7::double) * (len(list_intersect(words, pw)) / len(list_distinct(list_concat(words, pw)))) else s end as mixed,
                greatest(la, lb) / greatest(least(la, lb), 1) as q from sc)
            select seq, s as similarity, mixed >= 0.3 and s >= 0.45 and s * (case when q <= 1.5 then 1.0 when q <= 3 then 0.9 else 0.8 end)::double >= 0.3 as admitted from fx""",
        "stage_normalized": _canonical("select seq, normalized as message, cleaned as before from r"),
        "stage_dedup": _canonical("select seq, canonical as message, row_number() over (partition by canonical order by seq) = 1 as is_new_unique from r"),
        "vector_query_pairs": """
            select a.vec_id as query_id, b.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as dot,
              round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) + 1e-8), 6) as cosine
            from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0""",
        "label_centroid_mean": _centroids("select label, pos::bigint as pos, round(mean, 6) as mean, round(unit, 6) as unit from un"),
        "cluster_internal_similarity": _centroids(
            "select label, count(*) as n, round(case when count(*) < 2 then 1.0 else avg(s) end, 6) as similarity from (select x.label, x.vec_id, sum(x.v * me.mean) as s from x join me on x.label = me.label and x.pos = me.pos group by x.label, x.vec_id) group by label"
        ),
        "static_nearest_centroid": _centroids(
            "select vec_id, cluster, round(s, 6) as similarity from (select *, row_number() over (partition by vec_id order by round(s, 9) desc, cluster) as rn from ("
            "select x.vec_id, un.label as cluster, sum(x.v * un.unit) as s from x join un on x.pos = un.pos group by x.vec_id, un.label) where round(s, 9) >= 0.1) where rn = 1"
        ),
        "merge_candidates": _centroids("").rstrip() + ", " + _PAIR.strip() + "\nselect a, b, round(s, 6) as similarity, case when n_a >= n_b then a else b end as survivor from mc",
        "merged_centroids": _centroids("").rstrip()
        + ", "
        + _PAIR.strip()
        + "\nselect mc.a, mc.b, p.pos::bigint as pos, round((p.unit * n_a + q.unit * n_b) / (n_a + n_b), 6) as x from mc join un p on p.label = mc.a join un q on q.label = mc.b and q.pos = p.pos",
        "sentiment_guard": f"""
            with t as (select a, b, string_split(a, '') as x, string_split(b, '') as y from {_values(FEELINGS, 'a, b')})
            select a, b, len(list_filter(list_intersect(x, y), lambda c: c <> '')) >= 2 and ((len(list_intersect(x, [{praise}])) > 0 and len(list_intersect(y, [{blame}])) > 0)
              or (len(list_intersect(x, [{blame}])) > 0 and len(list_intersect(y, [{praise}])) > 0)) as opposed from t""",
        "head_tail_sample": "select label, vec_id from (select label, vec_id, row_number() over (partition by label order by vec_id) as h, row_number() over (partition by label order by vec_id desc) as t from embeddings) where h <= 25 or t <= 25",
        "top3_longest_examples": _lines("select stream, rank, raw_text from (select stream, raw as raw_text, row_number() over (partition by stream order by length(raw) desc, raw) as rank from (select distinct stream, raw from k)) where rank <= 3"),
        "confusable_pairs_mining": _canonical(
            """, cand as (select canonical as t from g where length(canonical) between 3 and 16 and n >= 2 order by md5(canonical) limit 2000),
            side as (select t, list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substr(t, i, 3))) as grams, regexp_replace(lower(t), '[^a-z]|[aeiou]', '', 'g') as key from cand),
            met as (select a.t as a, b.t as b, a.key as ka, b.key as kb, round(len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))), 6) as similarity from side a join side b on a.t < b.t)
            select a, b, similarity, case when similarity between 0.5 and 0.75 then 'spelling' else 'sound' end as kind from met
            where similarity between 0.5 and 0.75 or (similarity < 0.5 and levenshtein(ka, kb) <= 3)"""
        ),
        "new_term_candidates": _canonical("select canonical, n from g where length(canonical) between 3 and 16 and n >= 2 and canonical not in (select unnest(string_split(text, chr(10))) from benchmark)"),
    }
