"""The engine as an object: feed it messages, ask for its state, change thresholds while it runs.

``ingest`` takes a DataFrame of messages and folds it in as one micro-batch; ``attach`` does so with every
micro-batch of a stream.  Only the fold lives here, bounded by its slots; counts are a table that each batch
adds to.  A threshold that is set holds from the next message on.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import clustering, pipeline
from .operators.leader import Embed, LeaderFollower, hashed_ngrams
from .operators.metrics import StageTimer
from .streaming.push import Channel, Inbox


class Engine:
    """One ordered stream.  The driver folds, as the order of one stream allows no parallel part.

    A batch is known by its number.  What it counted and the fold after it are written under that number, so a batch
    that comes again is not folded in twice, and an engine that starts on an old folder goes on where it was."""

    _FOLD = "number long, total long, fold binary"

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings(), embed: Embed = hashed_ngrams, timed: bool = True):
        self.spark, self.folder, self.settings, self.embed = spark, folder, settings, embed
        self.fold = LeaderFollower(settings.cluster)
        self.total = 0
        self.last = -1
        self.timer = StageTimer(timed)
        self.listeners: list[Callable[[str], None]] = []
        held = self._table("fold", self._FOLD)
        if held is not None and (now := held.orderBy(F.desc("number")).first()) is not None:
            self.last, self.total, self.fold = now.number, now.total, pickle.loads(now.fold)

    def _table(self, name: str, schema: str) -> DataFrame | None:
        """A table of all batches, or None where none was written."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def set_threshold(self, centroid: float | None = None, anchor: float | None = None) -> None:
        """New thresholds of the regular tier, kept within 0.01 and 0.99."""
        self.fold.set_thresholds(centroid, anchor)

    def ingest(self, messages: DataFrame, number: int | None = None) -> list[tuple]:
        """Fold one micro-batch in, in order of seq; one decision for each message that cleansing keeps.  A batch whose
        number was folded in before changes nothing and gives nothing."""
        number = self.last + 1 if number is None else number
        if number <= self.last:
            return []
        n = messages.count()
        canonical = pipeline.stateless(messages, self.settings)
        with self.timer.stage("count", n):
            counted = canonical.groupBy("canonical").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
            counted.write.mode("overwrite").parquet(f"{self.folder}/counts/batch={number}")
        # rows come partition by partition, in order
        rows = canonical.selectExpr("stream", "seq", "unix_micros(ts) / 1e6 as at", "canonical", "raw_text").orderBy("seq")
        out: list[tuple] = []
        with self.timer.stage("fold", n):
            held: list[Row] = []
            for r in rows.toLocalIterator():
                held.append(r)
                if len(held) == self.settings.cluster.embed_batch:
                    out += self._fold_in(held)
                    held = []
            out += self._fold_in(held)
        self.total, self.last = self.total + n, number
        state = [(number, self.total, pickle.dumps(self.fold))]
        self.spark.createDataFrame(state, self._FOLD).write.mode("overwrite").parquet(f"{self.folder}/fold/batch={number}")
        self._forget(number - 2)
        for send in self.listeners:
            send(self.state())
        return out

    def _forget(self, number: int) -> None:
        """The fold of a batch that no restart asks for."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/fold/batch={number}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _fold_in(self, rows: list[Row]) -> list[tuple]:
        out = []
        for r, e in zip(rows, self.embed([r.canonical for r in rows]) if rows else [], strict=True):
            d = self.fold.take(r.seq, r.at, r.canonical, r.raw_text, e)
            out.append((r.seq, r.canonical, d.cluster_id, d.slot_id, d.is_new, d.hot))
        return out

    def drain(self, inbox: Inbox, most: int = 1000) -> list[tuple]:
        """Fold in what waits in an inbox, up to ``most`` messages; their decisions."""
        held = inbox.drain(most)
        if not held:
            return []
        rows = [(str(n), "inbox", n, text) for n, text in held]
        messages = self.spark.createDataFrame(rows, "msg_id string, stream string, seq long, raw_text string")
        return self.ingest(messages.withColumn("ts", F.current_timestamp()))

    def ask(self, text: str) -> tuple[str, str | None] | None:
        """One message typed in: its canonical text and the cluster it came to, or None if it is dropped."""
        rows = [("typed", "typed", 0, text)]
        seq = self._table("counts", "canonical string, n long, first_seq long, last_seq long")
        top = seq.agg(F.max("last_seq")).first()[0] if seq is not None else None
        typed = self.spark.createDataFrame(rows, "msg_id string, stream string, seq long, raw_text string").withColumn("seq", F.lit((-1 if top is None else top) + 1).cast("long"))
        said = self.ingest(typed.withColumn("ts", F.current_timestamp()))
        return (said[0][1], said[0][2]) if said else None

    def attach(self, messages: DataFrame):
        """A writer that ingests every micro-batch of a stream."""
        return messages.writeStream.foreachBatch(lambda batch, number: self.ingest(batch, number) and None)

    def events(self, send: Callable[[str], None]) -> None:
        """Send the state after every batch from now on."""
        self.listeners.append(send)

    def channel(self, size: int = 64) -> Channel:
        """A push channel that tells arriving clients the state, and all of them the state after every batch."""
        out = Channel(self.state, size)
        self.listeners.append(out.send)
        return out

    def registry(self) -> DataFrame:
        """canonical, n, first_seq, last_seq over all batches."""
        schema = "canonical string, n long, first_seq long, last_seq long"
        read = self._table("counts", schema)
        read = self.spark.createDataFrame([], schema) if read is None else read
        return read.groupBy("canonical").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))

    def state(self) -> str:
        """Totals, thresholds, slots and timings as JSON."""
        unique = self.registry().count()
        slots = [dict(zip(clustering._names(clustering.SLOT), row, strict=True)) for row in clustering.slot_rows("", self.fold)]
        return json.dumps(
            {
                "ingested": self.total,
                "unique": unique,
                "dedup_rate": round(1 - unique / self.total, 4) if self.total else 0.0,
                "centroid": self.fold.s.centroid_threshold,
                "anchor": self.fold.s.anchor_threshold,
                "max_slots": self.fold.s.max_slots,
                "timings": self.timer.stats(),
                "clusters": [s for s in slots if s["tier"] == "c"],
                "permanent": [s for s in slots if s["tier"] == "p"],
            },
            ensure_ascii=False,
        )
