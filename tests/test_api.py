"""The engine as an object, sinks, and expiry in a stream."""

import json

import pytest
from pyspark.sql import functions as F

from tidepool.config import ClusterSettings, Settings
from tidepool.engine import Engine
from tidepool.operators import clustering, pipeline, registry
from tidepool.sources import sinks
from tidepool.streaming import engine as streaming
from tidepool.streaming.push import Inbox

from .test_engine import chat, said

SCHEMA = "msg_id string, stream string, seq long, raw_text string"


def test_engine_equals_batch_and_reports(spark, tmp_path):
    rows = [(i, "s", n, t) for i, _, n, t in chat(spark, 200)]
    messages = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("seq"))
    settings = Settings(cluster=ClusterSettings(maintenance_interval=50, hot_count=20))
    one = Engine(spark, str(tmp_path), settings)
    sent = []
    one.events(sent.append)
    got = []
    for low, high in ((0, 70), (70, 80), (80, 200)):
        got += one.ingest(messages.filter(F.col("seq").between(low, high - 1)).repartition(3))
    want = clustering.assignments(pipeline.stateless(messages), settings.cluster).orderBy("seq").collect()
    assert got == [(r.seq, r.canonical, r.cluster_id, r.slot_id, r.is_new, r.hot) for r in want]
    assert {tuple(r) for r in one.registry().collect()} == {tuple(r) for r in registry.registry(pipeline.canonical(messages)).collect()}
    state = json.loads(sent[-1])
    assert len(sent) == 3 and state["ingested"] == 200 and state["unique"] == one.registry().count()
    assert sum(1 for _ in state["clusters"]) <= settings.cluster.max_slots
    assert state["timings"]["fold"]["count"] == 3


def test_a_batch_that_comes_again_and_a_restart(spark, tmp_path):
    rows = [(i, "s", n, t) for i, _, n, t in chat(spark, 90)]
    messages = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("seq"))
    part = lambda a, b: messages.filter(F.col("seq").between(a, b - 1))
    whole = Engine(spark, str(tmp_path / "whole"))
    want = whole.ingest(part(0, 30)) + whole.ingest(part(30, 60)) + whole.ingest(part(60, 90))
    one = Engine(spark, str(tmp_path / "parts"))
    got = one.ingest(part(0, 30), 0) + one.ingest(part(30, 60), 1)
    assert one.ingest(part(30, 60), 1) == []  # again
    two = Engine(spark, str(tmp_path / "parts"))  # after a restart
    assert two.ingest(part(30, 60), 1) == [] and two.total == 60
    got += two.ingest(part(60, 90), 2)
    assert got == want and {tuple(r) for r in two.registry().collect()} == {tuple(r) for r in whole.registry().collect()}


def test_typed_messages_and_clients(spark, tmp_path):
    one = Engine(spark, str(tmp_path), timed=False)
    channel = one.channel(size=2)
    client, slow = channel.subscribe(), channel.subscribe()
    assert json.loads(client.take()[0])["ingested"] == 0  # the state at arrival
    assert one.ask("nb") == ("牛逼", "c1") and one.ask("12345") is None and one.ask("牛批")[1] == "c1"
    assert len(client.take()) == 2 and client.dropped == 1  # two fit, the third was dropped
    assert len(slow.waiting) == 2 and slow.dropped == 2
    channel.leave(slow)
    assert channel.clients == [client] and json.loads(one.state())["timings"] == {}


def test_threshold_holds_from_the_next_message_on(spark, tmp_path):
    one = Engine(spark, str(tmp_path))
    one.ingest(said(spark, ["hello world"]))
    one.set_threshold(centroid=5, anchor=-3)
    assert (one.fold.s.centroid_threshold, one.fold.s.anchor_threshold) == (0.99, 0.01)
    one.set_threshold(centroid=0.01)
    assert one.ingest(said(spark, ["hello there"]))[0][4] is False  # joins now


def test_stage_dumps(spark, tmp_path):
    messages = said(spark, ["nb", "hhhh", "12345", "nb", 'with "quotes", and commas'])
    names = sinks.dump_stages(messages, str(tmp_path))
    read = {n: spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/{n}").collect() for n in names}
    assert [r.message for r in read["step1_filtered"]] == ["12345"]
    assert {r.message for r in read["step3_compressed"]} == {"牛逼", "哈", 'with "quotes", and commas'}
    assert {(r.text, r["count"], r["rank"], r.first_date) for r in read["step6_frequencies"]} >= {("牛逼", "2", "1", "1970-01-01")}
    assert sorted(r.message for r in read["step5_changed"]) == ["哈", "牛逼", "牛逼"] and len(names) == 8
    assert [(r.seq, r.is_new_unique) for r in sorted(read["step6_dedup"], key=lambda r: int(r.seq))] == [("0", "true"), ("1", "true"), ("3", "false"), ("4", "true")]


def test_append_variants(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "variant string, canonical string")
    for _ in range(2):
        sinks.append_variants(spark, pairs, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_rendered(spark):
    lines = sinks.rendered(clustering.clusters(pipeline.canonical(said(spark, ["hello world", "hello world"])))).collect()
    assert len(lines) == 1 and "hello world" in lines[0].line and " 2 " in lines[0].line


def test_expiry(spark, tmp_path):
    rows = [("a", 0), ("a", 10), ("b", 20), ("a", 30)]
    spark.createDataFrame(rows, "canonical string, t long").select("canonical", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("canonical string, ts timestamp").parquet(str(tmp_path / "in"))
    out = streaming.fresh_only(read, "canonical", "ts").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.canonical for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_inbox_refuses_when_full_and_is_drained_in_order(spark, tmp_path):
    inbox = Inbox(size=3)
    assert [inbox.offer(t) for t in ("hello there", "12345", "hello there", "too many")] == [True, True, True, False]
    one = Engine(spark, str(tmp_path), timed=False)
    assert [(s, c) for s, c, *_ in one.drain(inbox, 2)] == [(0, "hello there")]
    assert inbox.offer("now there is room") and inbox.refused == 1
    assert [s for s, *_ in one.drain(inbox)] == [2, 3] and one.drain(inbox) == [] and one.total == 4


class Cluster:
    """As much of a session as a folder is chosen by."""

    class Context:
        master = "local-cluster[2,1,1024]"

        def getConf(self):
            return self

        def get(self, name, default=None):
            return default

    sparkContext = conf = Context()


def test_a_cluster_has_to_name_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        streaming.shared_folder(Cluster(), "test")
