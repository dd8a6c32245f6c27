"""The registered queries of the message engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ClusterSettings
from ..functions import text as tx
from ..operators import clustering, dictionary, keywords, metrics, mining, pipeline, registry, simhash, vectors
from ..sources import dictionaries, messages, sinks
from ..streaming import engine

Query = Callable[[SparkSession, str], DataFrame]

#: Thresholds for the sample tables, whose vectors are nearly random: the usual ones would join nothing.
SAMPLE_CLUSTERS = ClusterSettings(centroid_threshold=0.3, anchor_threshold=0.45, hot_centroid_threshold=0.35, hot_anchor_threshold=0.5)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.document_lines(spark, sf_dir)


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.canonical(_lines(spark, sf_dir))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.counted(_lines(spark, sf_dir))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints(_registry(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the texts before the SimHash merge."""
    made = pipeline.compressed(_lines(spark, sf_dir))
    return simhash.fingerprints(made.groupBy(F.col("compressed").alias("canonical")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.canonical(messages.conversation_turns(spark, sf_dir))


def _table(name: str) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_events, _vectors = _table("events"), _table("embeddings")


def filtered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = pipeline.cleansed(_lines(spark, sf_dir))
    return split.select("seq", "filtered", F.when(F.col("filtered"), "filtered").otherwise("kept").alias("part"))


#: Variants of the sample's own words beside the engine's, so that the dictionary has something to do.
SAMPLE_LEXICON = dictionary.Lexicon.of(dict(dictionaries.entries()) | dictionaries.LATIN)

#: Messages that show every rule of cleansing, dictionary and compression, in order.
GOLDEN = [
    "", "   ", "１２３４５", "12345", "①②③④⑤", "666", "1234", "ＡＢＣ　ｄ", "a\t\n b", "x\u0007y", "x\u200by", "👨\u200d👩", "a" * 128 + "b", "哈哈哈哈哈哈", "加油加油加油加",
    "🎶🎤🐛🎶🎤🐛🎶🎤🐛", "aaabbb", "abab", "2333", "aaababab", "牛批", "nb", "ＮＢ", "yyds", "破防了", "？？不是", "hhhh", "nb nb nb", "nbc", "主播nb啊",
]

#: How some tokens sound, and messages in which such a token becomes a term once that term is trusted.
SOUNDS = [("佳油", "jia1you2"), ("加油", "jia1you2"), ("谢谢", "xie4xie4"), ("卸卸", "xie4xie4"), ("主播", "zhu3bo1"), ("煮播", "zhu3bo1")]
SOUNDED = ["佳油", "加油", "jiayou", "佳油啊", "加油", "佳油吧", "佳油", "佳油主播", "煮播佳油", "谢谢", "卸卸"]


def _listed(spark: SparkSession, texts: list[str]) -> DataFrame:
    rows = [(str(i), "listed", i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "msg_id string, stream string, seq long, raw_text string").withColumn("ts", F.timestamp_seconds("seq"))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage makes of the golden messages; null where cleansing drops one."""
    messages = _listed(spark, GOLDEN)
    made = pipeline.canonical(messages).select("seq", "cleaned", "normalized", "compressed")
    return messages.select("seq").join(made, "seq", "left")


def sounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame(SOUNDS, "token string, key string")
    words = dict(dictionaries.entries())
    known = {t for t, _ in SOUNDS} | {w for pair in words.items() for w in pair}
    lexicon = dictionary.Lexicon.of(words, lambda text: dictionary.segment(text, known, 8))
    return pipeline.canonical(_listed(spark, SOUNDED), lexicon=lexicon, keys=keys).select("seq", "canonical")


def key_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table("benchmark")(spark, sf_dir).select(F.explode(tx.tokens(F.col("text"))).alias("term"))
    return dictionary.unambiguous_keys(words.select("term", mining.sound_key(F.col("term")).alias("key")).filter("key <> ''"))


def dictionary_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.replace_whole(_canonical(spark, sf_dir), dictionary.pairs(spark, dictionaries.WHOLE_TEXT | dictionaries.LATIN))


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _canonical(spark, sf_dir)
    return vectors.neighbour_admission(lines, keywords.keywords(lines), SAMPLE_CLUSTERS)


def dedup_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return registry.dedup_rate(pipeline.cleansed(lines), pipeline.canonical(lines))


def keyword_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.keywords(pipeline.kept(_lines(spark, sf_dir)))
    return found.select("seq", F.array_join("keywords", ",").alias("keywords"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mean_centroids(_vectors(spark, sf_dir))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vectors.normalised_centroids(centroids(spark, sf_dir))
    return vectors.nearest_centroid(_vectors(spark, sf_dir), unit, threshold=0.1)


def merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.merge_candidates(vectors.normalised_centroids(centroids(spark, sf_dir)), threshold=0.0)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vectors.normalised_centroids(centroids(spark, sf_dir))
    return vectors.merged_centroids(unit, vectors.merge_candidates(unit, threshold=0.0))


#: Pairs of texts of opposite feeling, of like feeling and of none.
FEELINGS = [("这主播太强了真好", "这主播太菜了"), ("这主播太强了", "这主播真棒"), ("好听的歌", "难听的歌丑"), ("加油", "烂"), ("", "好")]


def feelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(FEELINGS, "a string, b string").select("a", "b", vectors.opposed(F.col("a"), F.col("b")).alias("opposed"))


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.confusable_pairs(mining.candidates(_registry(spark, sf_dir)))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table("benchmark")(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("canonical")).distinct()
    return mining.new_terms(_registry(spark, sf_dir), known)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = messages.conversation_turns(spark, sf_dir)
    slots = clustering.clusters(_turns(spark, sf_dir), SAMPLE_CLUSTERS)
    return metrics.snapshot(registry.dedup_rate(pipeline.cleansed(turns), pipeline.canonical(turns)), slots)


def drill_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of each stream's clusters: the last members of the first texts that they hold."""
    lines = _canonical(spark, sf_dir)
    held = clustering.assignments(lines, SAMPLE_CLUSTERS).groupBy("stream", "cluster_id", "canonical").agg(F.min("seq").alias("first_seq"))
    return clustering.drill_through(held, registry.last_members(lines))


#: Small intervals, so that maintenance, promotion and expiry all happen in the samples.
BUSY_CLUSTERS = ClusterSettings(
    centroid_threshold=0.3, anchor_threshold=0.45, hot_centroid_threshold=0.35, hot_anchor_threshold=0.5, maintenance_interval=100_000, hot_count=5, hot_ttl_seconds=20, merge_threshold=0.6, split_threshold=0.6
)


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.replayed(spark, _lines(spark, sf_dir), lambda m: engine.running_counts(pipeline.stateless(m)), "complete")


def streamed_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine.replayed(spark, _lines(spark, sf_dir), lambda m: engine.assignments(pipeline.stateless(m), SAMPLE_CLUSTERS), "append")
    return out.drop("late")


def counted_texts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("raw_text").agg(F.count("*").alias("n"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as JSON events, every third of which is no message, read as a source of messages."""
    kind = F.when(F.col("seq") % 3 == 0, "ping").otherwise("message")
    events = _lines(spark, sf_dir).select(F.to_json(F.struct(kind.alias("type"), F.col("raw_text").alias("message"))).alias("value"))
    return counted_texts(messages.json_events(events))


def query_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as requests with the text as a parameter."""
    urls = _lines(spark, sf_dir).select(F.concat(F.lit("http://localhost/ingest?msg_id=1&text="), F.url_encode("raw_text")).alias("url"))
    return counted_texts(messages.query_string(urls, "url"))


def csv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as a CSV with a time in milliseconds, replayed from there in order of time."""
    folder = engine.shared_folder(spark, "csv")
    rows = _lines(spark, sf_dir).select(F.col("raw_text").alias("message"), F.unix_millis("ts").cast("string").alias("timestamp"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    rows.write.option("header", True).option("escape", '"').csv(f"{folder}/replay")
    replayed = messages.replay_csv(spark, f"{folder}/replay")
    return replayed.select("raw_text", F.unix_millis("ts").alias("at_ms"), "date")


def file_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as a file and read line by line."""
    folder = engine.shared_folder(spark, "text")
    _table("documents")(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("value")).write.text(f"{folder}/lines")
    return counted_texts(messages.text_lines(spark, f"{folder}/lines"))


def lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The browser's cleansing."""
    return _lines(spark, sf_dir).select("seq", tx.cleanse_lite(F.col("raw_text")).alias("cleaned")).filter("cleaned is not null")


def stage_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.stage_distances(_canonical(spark, sf_dir).select("cleaned", F.col("compressed").alias("canonical")))


def queries() -> dict[str, Query]:
    c, r = _canonical, _registry
    return {
        "cleanse_messages": lambda s, d: pipeline.kept(_lines(s, d)).select("seq", "stream", "cleaned"),
        "event_messages": event_messages,
        "query_string_messages": query_messages,
        "replay_csv_messages": csv_messages,
        "text_file_messages": file_messages,
        "cleanse_lite_messages": lite,
        "cleanse_filtered_split": filtered_split,
        "normalize_messages": lambda s, d: pipeline.compressed(_lines(s, d), lexicon=SAMPLE_LEXICON).select("seq", "cleaned", "normalized", "compressed"),
        "cycle_compress": lambda s, d: pipeline.compressed(_lines(s, d)).select("normalized", "compressed").distinct(),
        "golden_stages": golden,
        "homophone_replace": sounded,
        "stage_change_counts": lambda s, d: pipeline.stage_changes(_lines(s, d)),
        "whole_text_variant": dictionary_whole,
        "token_dictionary_replace": lambda s, d: dictionary.replace_in_text(c(s, d), SAMPLE_LEXICON),
        "unambiguous_key_map": key_map,
        "canonical_registry": r,
        "first_five_examples": lambda s, d: registry.first_examples(c(s, d)),
        "members_last_n": lambda s, d: registry.last_members(c(s, d)),
        "unique_and_dedup_rate": dedup_rate,
        "distinct_raws": lambda s, d: registry.distinct_raws(c(s, d)),
        "frequency_rank": lambda s, d: registry.frequency_rank(c(s, d)),
        "first_seen_layer": lambda s, d: registry.layers(c(s, d)),
        "running_trust": lambda s, d: registry.running_trust(c(s, d)),
        "frequency_table": lambda s, d: registry.frequency_table(c(s, d)),
        "cache_hit_stage": lambda s, d: registry.cache_hit_stage(pipeline.canonical(_lines(s, d), lexicon=SAMPLE_LEXICON)),
        "cache_ttl_liveness": lambda s, d: registry.liveness(_events(s, d), "user_id", "ts", "event_id"),
        "duplicate_hit_rate": lambda s, d: registry.duplicate_rate(c(s, d)),
        "stage_latency_stats": lambda s, d: metrics.timing(_events(s, d), "event_type", "value", "event_id"),
        "stage_moving_mean": lambda s, d: metrics.moving_mean(_events(s, d), "event_type", "value", "event_id"),
        "replay_pacing": lambda s, d: metrics.pacing(_events(s, d), "ts", "event_id", speed=2.0),
        "recent_log": lambda s, d: registry.recent(c(s, d)),
        "heat_ratio": lambda s, d: registry.heat(c(s, d)),
        "event_json_numbers": lambda s, d: metrics.event_numbers(_events(s, d)),
        "training_pairs": lambda s, d: dictionary.training_pairs(s),
        "variant_dictionary": lambda s, d: messages.variants(s),
        "simhash_fingerprint": lambda s, d: _prints(s, d).select("canonical", tx.hex16(F.col("fp")).alias("fp")),
        "simhash_effective_merge": lambda s, d: simhash.merge_equal(_texts(s, d)),
        "simhash_near_dup_pairs": lambda s, d: simhash.near_pairs(_prints(s, d)),
        "simhash_kinds": lambda s, d: simhash.near_pairs(_prints(s, d)).groupBy("kind").agg(F.count("*").alias("n")),
        "simhash_nearest_canonical": lambda s, d: simhash.nearest_canonical(_prints(s, d)),
        "hamming_histogram": stage_distances,
        "keyword_topk_per_message": keyword_top,
        "keyword_signature": lambda s, d: keywords.signature(keywords.keywords(pipeline.kept(_lines(s, d))), "stream"),
        "keyword_jaccard_pairs": lambda s, d: keywords.neighbour_similarity(keywords.keywords(pipeline.kept(_lines(s, d)))),
        "length_penalty_pairs": lambda s, d: vectors.neighbour_penalty(c(s, d)),
        "neighbour_admission": admission,
        "vector_query_pairs": lambda s, d: vectors.query_pairs(_vectors(s, d)),
        "label_centroid_mean": lambda s, d: vectors.centroid_places(_vectors(s, d)),
        "cluster_internal_similarity": lambda s, d: vectors.internal_similarity(_vectors(s, d)),
        "static_nearest_centroid": nearest,
        "merge_candidates": merging,
        "merged_centroids": merged,
        "sentiment_guard": feelings,
        "head_tail_sample": lambda s, d: vectors.head_and_tail(_vectors(s, d), "label", "vec_id").select("label", "vec_id"),
        "top3_longest_examples": lambda s, d: vectors.longest_examples(pipeline.kept(_lines(s, d)), "stream"),
        "leader_follower_assignments": lambda s, d: clustering.assignments(c(s, d), SAMPLE_CLUSTERS),
        "leader_follower_clusters": lambda s, d: clustering.clusters(c(s, d), SAMPLE_CLUSTERS),
        "maintenance_merge_split": lambda s, d: clustering.clusters(c(s, d), BUSY_CLUSTERS),
        "hot_cluster_ttl": lambda s, d: clustering.clusters(c(s, d), BUSY_CLUSTERS).filter("tier = 'p'"),
        "rendered_clusters": lambda s, d: sinks.rendered(clustering.clusters(c(s, d), SAMPLE_CLUSTERS)),
        "stage_normalized": lambda s, d: sinks.stages(_lines(s, d))["step2_normalized"].select("seq", "message", "before"),
        "stage_dedup": lambda s, d: sinks.stages(_lines(s, d))["step6_dedup"].select("seq", "message", "is_new_unique"),
        "stream_registry_counts": streamed_counts,
        "stream_leader_follower": streamed_assignments,
        "cluster_drill_through": drill_through,
        "confusable_pairs_mining": mined,
        "new_term_candidates": terms,
        "engine_state_snapshot": state,
    }
