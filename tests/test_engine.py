"""Registry, SimHash, clustering and streaming."""

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.config import ClusterSettings
from tidepool.operators import clustering, metrics, mining, ordered, pipeline, registry, simhash, vectors
from tidepool.operators.leader import LeaderFollower, hashed_ngrams, model, register_model, two_means
from tidepool.sources import messages, sinks
from tidepool.streaming import engine

from .conftest import SF


def said(spark, texts, stream="s"):
    rows = [(str(i), stream, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "msg_id string, stream string, seq long, raw_text string").withColumn("ts", F.timestamp_seconds("seq"))


def test_registry_golden(spark):
    c = pipeline.canonical(said(spark, ["a", "b", "a", "a", "c", "a"]))
    assert {r.canonical: r.n for r in registry.registry(c).collect()} == {"a": 4, "b": 1, "c": 1}
    assert [r.layer for r in registry.layers(c).orderBy("seq").collect()] == [3, 3, 1, 1, 3, 1]
    trust = [r.trusted for r in registry.running_trust(c).orderBy("seq").collect()]
    assert trust == [False, False, False, False, False, True]  # three came before the sixth
    assert {r.canonical: r.members for r in registry.last_members(c, 2).collect()}["a"] == "a|a"


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿message,timestamp,date\n second ,2000,d\n,1000,d\nfirst,1000,d\n", encoding="utf-8")
    got = [(r.raw_text, r.ts.second) for r in messages.replay_csv(spark, str(tmp_path / "m.csv")).collect()]
    assert got == [("first", 1), ("second", 2)]
    (tmp_path / "t.txt").write_text("one\n\n  two  \n")
    assert [r.raw_text for r in messages.text_lines(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]
    events = spark.createDataFrame([('{"type":"message","message":"hi"}',), ('{"type":"ping"}',), ('{"type":"message","message":""}',), ("broken",)], "value string")
    assert [r.raw_text for r in messages.json_events(events).collect()] == ["hi"]
    urls = spark.createDataFrame([("http://h/ingest?text=a%20b+c",), ("http://h/ingest?text=",), ("http://h/ingest",)], "url string")
    assert [r.raw_text for r in messages.query_string(urls, "url").collect()] == ["a b c"]
    (tmp_path / "v.json").write_text('{"XX": "yy"}')
    assert [tuple(r) for r in messages.variants_json(spark, str(tmp_path / "v.json")).collect()] == [("xx", "yy")]
    assert {r.variant: r.canonical for r in messages.variants(spark).collect()}["破防了"] == "哭了"
    (tmp_path / "v.yaml").write_text("variants:\n  good: [gd, 'go od']\n  bad:\n    - bd\n  none:\n", encoding="utf-8")
    assert messages.variants_yaml(spark, str(tmp_path / "v.yaml")) == [("gd", "good"), ("go od", "good"), ("bd", "bad")]
    base, upload = (spark.createDataFrame(x, "variant string, canonical string") for x in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert {tuple(r) for r in messages.variants_over(base, upload).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


@pytest.mark.parametrize("distance", [0, 2, 3, 7])
def test_near_pairs_against_brute_force(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(1 << 62), 1 << 62, 25).tolist()
    fps = []
    for b in base:
        for _ in range(4):
            x = b
            for bit in rng.integers(0, 62, rng.integers(0, 9)).tolist():
                x ^= 1 << bit
            fps.append(x)
    rows = [(f"text number {i}", i, x) for i, x in enumerate(fps)]
    got = simhash.near_pairs(spark.createDataFrame(rows, "canonical string, first_seq long, fp long"), distance).collect()
    want = {(rows[i][0], rows[j][0]) for i, j in combinations(range(len(fps)), 2) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= distance}
    assert {(r.canonical_a, r.canonical_b) for r in got} == want and len(got) == len(want)


def test_head_and_tail_is_the_incremental_rule(spark):
    rows = spark.createDataFrame([("g", i) for i in range(60)], "g string, i long")
    got = sorted(r.i for r in vectors.head_and_tail(rows, "g", "i").collect())
    assert got == [*range(25), *range(35, 60)]


def test_admission_golden():
    def slot_with(words):
        fold = LeaderFollower()
        fold.take(0, 0.0, "xxxx", "xxxx", np.array([1.0, 0.0]))
        slot = fold.regular["xxxx"]
        slot.top_words = words
        return fold, slot

    fold, slot = slot_with(["a"])
    admits = lambda s, c, a, words: fold.admits(slot, s, "xxxx", words, c, a)
    assert admits(0.60, 0.4, 0.6, ["z"]) and not admits(0.59, 0.4, 0.6, ["a"])
    assert not admits(0.9, 0.75, 0.82, ["z"]) and admits(0.9, 0.75, 0.82, ["a"])


def naive_fold(rows, s):
    """The regular tier alone, written the long way round."""
    slots, out, opened = [], [], 0
    for seq, text, e in rows:
        best = None
        for slot in slots:
            near = float(slot["c"] @ e)
            inner = 1.0 if len(slot["m"]) < 2 else sum(float(m @ slot["c"]) for m in slot["m"]) / len(slot["m"])
            if near >= s.anchor_threshold and not (len(slot["m"]) >= 3 and inner < s.split_threshold) and (best is None or near > best[0]):
                best = (near, slot)
        if best:
            slot = best[1]
            slot["n"] += 1
            slot["c"] = (slot["c"] * (slot["n"] - 1) + e) / slot["n"]
            slot["m"] = (slot["m"] + [e]) if len(slot["m"]) < s.max_members else (slot["m"] + [e])[: s.max_members // 2] + (slot["m"] + [e])[-(s.max_members // 2) :]
            slot["t"] = seq
        else:
            slots = [x for x in slots if x["k"] != text]
            if len(slots) == s.max_slots:
                slots.remove(min(slots, key=lambda x: x["t"]))
            opened += 1
            slot = {"k": text, "id": f"c{opened}", "c": e, "n": 1, "m": [e], "t": seq}
            slots.append(slot)
        out.append(slot["id"])
    return out


@pytest.mark.parametrize("seed", range(5))
def test_fold_against_a_naive_model(seed):
    rng = np.random.default_rng(seed)
    s = ClusterSettings(anchor_threshold=0.7, max_slots=6, max_members=8, maintenance_interval=10**9, hot_count=10**9)
    centres = rng.normal(size=(9, 8))
    rows = []
    for k in range(300):
        e = centres[rng.integers(0, 9)] + 0.4 * rng.normal(size=8)
        rows.append((k, f"t{rng.integers(0, 60)}", e / np.sqrt(e @ e)))
    fold = LeaderFollower(s)
    # "xx" is short and has one keyword, which all share: similarity alone decides
    got = [fold.take(k, float(k), t, "xx", e).cluster_id for k, t, e in rows]
    assert got == naive_fold(rows, s)
    assert len(fold.regular) <= s.max_slots and all(len(x.members) <= s.max_members for x in fold.regular.values())


def test_maintenance_promotion_and_expiry():
    s = ClusterSettings(hot_count=5, maintenance_interval=10, hot_ttl_seconds=3)
    fold = LeaderFollower(s)
    e = np.array([1.0, 0.0])
    last = [fold.take(k, float(k), "hello", "hello", e) for k in range(6)][-1]
    assert last.hot and last.cluster_id == "p1" and not fold.regular
    fold.take(30, 30.0, "other", "other", np.array([0.0, 1.0]))
    assert not fold.hot and len(fold.regular) == 1
    a, b = (LeaderFollower(s) for _ in range(2))
    for f in (a, b):
        f.take(0, 0.0, "a", "a", e)
        f.regular["b"] = type(f.regular["a"])("b", "c9", 2, "b", np.array([0.99, 0.14]), 1.0, 3)
    a.maintain(1.0)
    assert list(a.regular) == ["b"] and a.regular["b"].count == 4


def test_split_of_a_spread_slot():
    fold = LeaderFollower(ClusterSettings())
    e = [np.array(x) for x in ([1.0, 0, 0, 0], [0, 1.0, 0, 0], [1.0, 0, 0, 0], [0, 1.0, 0, 0])]
    fold.take(0, 0.0, "k", "k", e[0])
    slot = fold.regular["k"]
    slot.members, slot.centroid = [(x, "r") for x in e], np.array([0.4, 0.4, 0, 0])
    fold.maintain(0.0)
    assert sorted(fold.regular) == ["k", "k*"] and {x.count for x in fold.regular.values()} == {2}
    assert [(x.cluster_id, x.slot_id, x.canonical) for x in fold.regular.values()] == [("c1", 1, "k"), ("c2", 2, "k")]
    assert two_means(np.stack(e)).tolist() == [0, 1, 0, 1]


def chat(spark, n=400):
    words = ["hello there", "good game", "nice play", "what a goal", "no way", "hello theree", "good gamee"]
    rng = np.random.default_rng(0)
    rows = [(str(i), f"s{i % 2}", i, words[rng.integers(0, len(words))] + " " + str(rng.integers(0, 4))) for i in range(n)]
    return rows


def test_stream_equals_batch(spark, tmp_path):
    rows = chat(spark)
    schema = "msg_id string, stream string, seq long, raw_text string"
    s = ClusterSettings(maintenance_interval=50, hot_count=20)
    timed = lambda df: pipeline.stateless(df.withColumn("ts", F.timestamp_seconds("seq")))
    for k, size in enumerate([150, 10, 240]):
        part = rows[sum([150, 10, 240][:k]) :][:size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        read = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for name, frame, mode in (("counts", engine.running_counts(timed(read)), "complete"), ("folded", engine.assignments(timed(read), s), "append")):
            if mode == "append":
                sink = frame.writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode(mode)
            else:
                sink = frame.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(str(tmp_path / "counts")))
            # each round restarts from the checkpoint
            sink.option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).start().awaitTermination()
    batch = timed(spark.createDataFrame(rows, schema))
    counts = {tuple(r) for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    assert counts == {tuple(r) for r in registry.registry(batch).collect()}
    got = {(r.stream, r.seq): (r.cluster_id, r.is_new, r.hot) for r in spark.read.parquet(str(tmp_path / "folded")).collect()}
    want = {(r.stream, r.seq): (r.cluster_id, r.is_new, r.hot) for r in clustering.assignments(batch, s).collect()}
    assert got == want and len(got) == 400


def test_published_batches(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",)], "canonical string").selectExpr("canonical", "cast(1 as long) as seq").write.parquet(str(tmp_path / "in"))
    sent = []
    read = spark.readStream.schema("canonical string, seq long").parquet(str(tmp_path / "in"))
    engine.publish(engine.running_counts(read), sent.append, "complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert sent == [['{"canonical":"a","n":2,"first_seq":1,"last_seq":1}']]


def test_mining(spark):
    found = spark.createDataFrame([("hello", 5), ("hallo", 2), ("xyz", 9), ("zz", 4)], "canonical string, n long")
    pairs = mining.confusable_pairs(mining.candidates(found)).collect()
    assert ("hallo", "hello", "sound") in {(r.a, r.b, r.kind) for r in pairs}
    near = lambda texts: np.array([[1.0, 0.0] if t.startswith("h") else [0.6, 0.8] for t in texts])
    keys = spark.createDataFrame([("hello", "k1"), ("xyz", "k2")], "token string, key string")
    by_vector = mining.confusable_pairs(mining.candidates(found), embed=near, keys=keys).collect()
    assert {(r.a, r.b, r.similarity, r.kind) for r in by_vector} == {("hallo", "xyz", 0.6, "spelling"), ("hello", "xyz", 0.6, "spelling")}
    terms = mining.new_terms(found, spark.createDataFrame([("xyz",)], "canonical string"))
    assert {r.canonical for r in terms.collect()} == {"hello", "hallo"}
    kept = mining.confirmed(spark.createDataFrame([("hallo", "hello"), ("p", "q")], "a string, b string"), found).collect()
    assert {tuple(r) for r in kept} == {("hallo", "hello"), ("q", "p")}


def test_invariants_on_the_sample(spark):
    lines = messages.document_lines(spark, SF)
    c = pipeline.canonical(lines)
    total = c.count()
    assert registry.registry(c).agg(F.sum("n")).first()[0] == total
    slots = clustering.clusters(c, ClusterSettings(anchor_threshold=0.5)).toPandas()
    assert (slots[slots.tier == "c"].groupby("stream").size() <= 40).all() and (slots.n_members <= 50).all()
    assert abs(float(hashed_ngrams(["hello"])[0] @ hashed_ngrams(["hello"])[0]) - 1) < 1e-9
    assert isinstance(metrics.snapshot(registry.dedup_rate(pipeline.cleansed(lines), c), clustering.clusters(c)).first().state, str)
    assert isinstance(slots, pd.DataFrame)


def test_hot_slots_split_with_numbers_of_their_own():
    fold = LeaderFollower(ClusterSettings(hot_count=3, hot_split_threshold=0.9, hot_centroid_threshold=0.0, hot_anchor_threshold=0.0))
    for k in range(3):
        fold.take(k, 0.0, "k", "k", np.array([1.0, 0.0]))
    slot = fold.hot["k"]
    assert (slot.cluster_id, slot.slot_id) == ("p1", 1)
    slot.members = [(np.array(x), "r") for x in ([1.0, 0], [0, 1.0], [1.0, 0], [0, 1.0])]
    fold.maintain(0.0)
    assert [(x.cluster_id, x.slot_id) for x in fold.hot.values()] == [("p1", 1), ("p2", 2)]


def test_new_dimension_empties_a_tier_and_thresholds_hold_from_here():
    fold = LeaderFollower()
    fold.take(0, 0.0, "a", "a", np.array([1.0, 0.0]))
    fold.take(1, 1.0, "b", "b", np.array([1.0, 0.0, 0.0]))
    assert list(fold.regular) == ["b"]
    fold.set_thresholds(centroid=5, anchor=-1)
    assert (fold.s.centroid_threshold, fold.s.anchor_threshold) == (0.99, 0.01)


def test_control_changes_thresholds_on_the_way(spark):
    lines = said(spark, ["hello there", "hello thxre", "hello thyre"])
    control = spark.createDataFrame([("s", 1, 0.99, 0.99), ("s", 2, 0.01, 0.01)], "stream string, seq long, centroid double, anchor double")
    made = pipeline.canonical(lines)
    plain = [r.is_new for r in clustering.assignments(made).orderBy("seq").collect()]
    told = [r.is_new for r in clustering.assignments(made, control=control).orderBy("seq").collect()]
    assert plain == [True, False, False] and told == [True, True, False]


def test_models_are_asked_for_batches_and_loaded_once():
    asked, loaded = [], []

    def factory():
        loaded.append(1)
        return lambda texts: (asked.append(len(texts)), hashed_ngrams(texts))[1]

    one = register_model("counting", factory, batch=3)
    assert one([f"t{i}" for i in range(8)]).shape == (8, 64) and model("counting", 5)(["x"]).shape == (1, 64)
    assert asked == [3, 3, 2, 1] and loaded == [1]


def test_null_streams_fold_apart(spark):
    rows = [("1", None, 1, "hello"), ("2", "a", 2, "hello"), ("3", None, 3, "hello")]
    made = pipeline.canonical(spark.createDataFrame(rows, "msg_id string, stream string, seq long, raw_text string").withColumn("ts", F.timestamp_seconds("seq")))
    assert {(r.stream, r.seq): r.is_new for r in clustering.assignments(made).collect()} == {(None, 1): True, ("a", 2): True, (None, 3): False}
    assert {(r.stream, r.total_count) for r in clustering.clusters(made).collect()} == {(None, 2), ("a", 1)}


def test_ordered_helpers_do_not_depend_on_stretches(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"k{rng.integers(0, 3)}", int(i), int(rng.integers(0, 9))) for i in rng.permutation(200)], "k string, i long, v int")
    for span in (1, 7, 1 << 40):
        assert {tuple(r) for r in ordered.previous(rows, "k", "i", "v", "before", span).collect()} == {
            tuple(r) for r in rows.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("i"))).filter("before is not null").collect()
        }
        assert {tuple(r) for r in ordered.count_before(rows, "k", "i", "n", span).collect()} == {tuple(r) for r in rows.withColumn("n", (F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1).cast("long")).collect()}


def test_merge_of_equal_fingerprints_is_part_of_the_pipeline(spark, monkeypatch):
    lines = said(spark, ["first long text", "another long text", "short", "first long text", "third long text"])
    real = simhash.fingerprint
    monkeypatch.setattr(simhash, "fingerprint", lambda text, ngram=3: F.when(text.like("%long%") & ~text.like("third%"), F.lit(7).cast("long")).otherwise(real(text, ngram)))
    made = pipeline.canonical(lines)
    assert [r.canonical for r in made.orderBy("seq").collect()] == ["first long text", "first long text", "short", "first long text", "third long text"]
    assert {(r.canonical, r.n) for r in pipeline.counted(lines).collect()} == {("first long text", 3), ("short", 1), ("third long text", 1)}
    assert pipeline.stage_changes(lines).first().simhash_merged == 1


def test_votes_of_long_texts(spark):
    """More n-grams than the packed counters hold are counted one by one."""
    texts = ["".join(chr(97 + (i * i + 3 * i) % 17) for i in range(n)) for n in (1, 2, 8, 128, 129, 130, 400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", simhash.fingerprint(F.col("t")).alias("fp")).collect():
        grams = [r.t[i : i + 3] for i in range(max(1, len(r.t) - 2))]
        hashes = [int.from_bytes(hashlib.md5(g.encode()).digest()[8:], "big") for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fp & (1 << 64) - 1 == want


def test_sliding_expiry_in_a_stream(spark, tmp_path):
    rows = [("a", 0), ("a", 500), ("a", 1000), ("b", 1000), ("a", 1700), ("b", 1500), ("a", 2299)]
    frame = spark.createDataFrame(rows, "canonical string, t long").select("canonical", F.timestamp_seconds(F.col("t") + 10**6).alias("ts"))
    for k in range(0, len(rows), 3):  # several micro-batches
        spark.createDataFrame(rows[k : k + 3], "canonical string, t long").select("canonical", F.timestamp_seconds(F.col("t") + 10**6).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = engine.cache_hits(read, "canonical", "ts", delay="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination()
    got = {(r.canonical, int(r.ts.timestamp()) - 10**6): r.hit for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): False, ("a", 500): True, ("a", 1000): True, ("a", 1700): False, ("a", 2299): True, ("b", 1000): False, ("b", 1500): True}


def test_idle_hot_slots_go_by_a_timer(spark, tmp_path):
    """A stream that has been silent for the hot slots' time to live loses them when the watermark passes."""
    schema = "msg_id string, stream string, seq long, raw_text string"
    s = ClusterSettings(hot_count=2, hot_ttl_seconds=10, maintenance_interval=10**9)
    batches = [[("1", "x", 1, "hello"), ("2", "x", 2, "hello")], [("3", "y", 100, "other")], [("4", "y", 200, "other")], [("5", "x", 201, "hello")]]
    for b in batches:
        spark.createDataFrame(b, schema).withColumn("ts", F.timestamp_seconds("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, idle in (("timed", "1 second"), ("plain", None)):
        out = engine.assignments(pipeline.stateless(read), s, idle=idle).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"at-{name}")).outputMode("append")
        out.trigger(availableNow=True).start().awaitTermination()
    seen = {name: {r.seq: (r.cluster_id, r.is_new) for r in spark.read.parquet(str(tmp_path / name)).collect()} for name in ("timed", "plain")}
    assert seen["plain"][201] == ("p1", False) and seen["timed"][201][1] is True


def test_stage_timer():
    timer, off = metrics.StageTimer(recent=2), metrics.StageTimer(False)
    for ms in (1.0, 2.0, 6.0):
        timer.record("a", ms)
        off.record("a", ms)
    with timer.stage("b", 10), off.stage("b"):
        pass
    assert timer.stats()["a"] == {"avg_ms": 3.0, "recent_avg_ms": 4.0, "min_ms": 1.0, "max_ms": 6.0, "count": 3}
    assert list(timer.stats()) == ["a", "b"] and off.stats() == {}


def test_paced_replay_writes_files_in_time(spark, tmp_path):
    rows = spark.createDataFrame([("a", 100), ("b", 101), ("c", 104), ("d", 110)], "raw_text string, t long").select("raw_text", F.timestamp_seconds("t").alias("ts"))
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(round(seconds, 3))
        now[0] += seconds

    assert engine.paced(rows, str(tmp_path / "in"), speed=2.0, clock=lambda: now[0], sleep=sleep) == 3
    assert slept == [0.0, 2.0, 3.0] and sorted(r.raw_text for r in spark.read.parquet(str(tmp_path / "in")).collect()) == ["a", "b", "c", "d"]


def test_a_message_costs_the_same_however_much_a_slot_has_seen():
    class Looked(dict):
        times = 0

        def __getitem__(self, key):
            Looked.times += 1
            return super().__getitem__(key)

    fold = LeaderFollower(ClusterSettings(hot_count=10**9, centroid_threshold=0.01, anchor_threshold=0.01, keyword_weight=1.0))
    e = np.array([1.0, 0.0])
    fold.take(0, 0.0, "t", "word", e)
    slot = fold.regular["t"]
    slot.words = Looked(slot.words)
    said = [f"{'word ' * (k % 3)}{'then ' * (k % 2)}a{k} b{k} c{k}" for k in range(1, 400)]
    for k, text in enumerate(said, 1):
        fold.take(k, float(k), text, text, e)
    assert slot.count == 400 and len(slot.canonicals) == 400 and len(slot.words) > 1000
    assert Looked.times < 400 * 4 * 5
    assert slot.top_words == sorted(dict(slot.words), key=lambda w: -dict.__getitem__(slot.words, w))[:5]


def test_absorbed_words_and_stored_folds():
    fold = LeaderFollower(ClusterSettings(merge_threshold=0.9))
    e = np.array([1.0, 0.0])
    fold.take(0, 0.0, "a", "one two", e)
    other = LeaderFollower()
    other.take(1, 1.0, "b", "three two", e)
    target, source = fold.regular["a"], other.regular["b"]
    fold._absorb(target, source)
    assert (target.top_words, list(target.canonicals), target.count) == (["two", "one", "three"], ["a", "b"], 2)
    state = target.__getstate__() | {"canonicals": ["a", "b"]}  # as it was stored when these were a list
    again = type(target).__new__(type(target))
    again.__setstate__(state)
    again.note("three", 5, ["three"])
    assert again.top_words == ["two", "three", "one"] and list(again.canonicals) == ["a", "b"]


def test_spread_is_judged_as_by_similarity():
    rng = np.random.default_rng(3)
    fold = LeaderFollower(ClusterSettings(anchor_threshold=-1.0, centroid_threshold=-1.0, split_threshold=-1.0, max_members=8, hot_count=10**9, maintenance_interval=10**9))
    for k in range(60):
        e = rng.normal(size=8)
        fold.take(k, float(k), f"t{k}", "xx", e / np.sqrt(e @ e))
        for slot in fold.regular.values():
            want = float(np.mean([x @ slot.centroid for x, _ in slot.members])) if len(slot.members) > 1 else 1.0
            assert slot.similarity() == want and all(slot.spread(b) == (want < b) for b in (-2.0, want - 1e-3, want, want + 1e-12, want + 1e-3, 2.0))


def test_rendering_folds_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return hashed_ngrams(texts)

    made = pipeline.canonical(said(spark, ["hello there", "good morning", "one more line"]))
    assert len(sinks.rendered(clustering.clusters(made, embed=embed)).collect()) == 3
    assert asked.value == 3
