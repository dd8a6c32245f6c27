"""Measurements: stage timings, replay pacing, the state of the engine."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def timing(measured: DataFrame, stage: str, value: str, order: str, recent: int = 100) -> DataFrame:
    """stage, n, avg, min, max, and the mean of the last ``recent`` measurements, which are ranked before they are averaged."""
    whole = measured.groupBy(stage).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("avg_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
    last = measured.withColumn("rank", F.row_number().over(Window.partitionBy(stage).orderBy(F.desc(order)))).filter(F.col("rank") <= recent)
    return whole.join(last.groupBy(stage).agg(F.round(F.avg(value), 6).alias("recent_ms")), stage)


def moving_mean(measured: DataFrame, stage: str, value: str, order: str, recent: int = 100) -> DataFrame:
    """order, stage and the mean of the last ``recent`` measurements of the stage up to each; halves of the sixth place go
    up, in whatever order the sum was made."""
    last = Window.partitionBy(stage).orderBy(order).rowsBetween(-(recent - 1), 0)
    return measured.select(order, stage, F.round(F.avg(value).over(last) + 1e-9, 6).alias("recent_ms"))


def pacing(events: DataFrame, ts: str, order: str, speed: float = 1.0) -> DataFrame:
    """order and the seconds after the first event at which a replay at the given speed sends it."""
    first = events.agg(F.min(ts).alias("first_ts"))
    offset = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / F.lit(1e6 * speed)
    return events.join(F.broadcast(first)).select(order, F.round(offset, 3).alias("offset_s"))


def event_numbers(events: DataFrame) -> DataFrame:
    """event_id and k from JSON properties, where they have it."""
    return events.select("event_id", F.from_json("props", "k long").alias("p")).filter("p.k is not null").select("event_id", F.col("p.k").alias("k"))


def snapshot(rates: DataFrame, clusters: DataFrame) -> DataFrame:
    """The engine's state as one JSON row: totals, and clusters by falling count."""
    listed = clusters.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("total_count")).alias("o"), "stream", "cluster_id", "total_count", "canonical_text"))), lambda c: F.struct(c["stream"].alias("stream"), c["cluster_id"].alias("cluster_id"), c["total_count"].alias("total_count"), c["canonical_text"].alias("canonical_text"))).alias("clusters"))
    return rates.join(listed).select(F.to_json(F.struct("total", "n_unique", "dedup_rate", "clusters")).alias("state"))


class StageTimer:
    """Wall times of the stages of a running engine, in milliseconds; a timer that is off does nothing."""

    def __init__(self, enabled: bool = True, recent: int = 100):
        self.enabled, self.recent = enabled, recent
        self.times: dict[str, deque[float]] = {}
        self.sums: dict[str, tuple[int, float, float, float]] = {}

    def record(self, stage: str, ms: float) -> None:
        if self.enabled:
            n, total, least, most = self.sums.get(stage, (0, 0.0, ms, ms))
            self.sums[stage] = n + 1, total + ms, min(least, ms), max(most, ms)
            self.times.setdefault(stage, deque(maxlen=self.recent)).append(ms)

    @contextmanager
    def stage(self, name: str, messages: int = 1) -> Iterator[None]:
        """Time what happens inside; for a batch, the mean of its messages."""
        if not self.enabled:
            yield
            return
        began = time.perf_counter()
        yield
        self.record(name, (time.perf_counter() - began) * 1000 / max(1, messages))

    def stats(self) -> dict[str, dict[str, float]]:
        """avg, recent avg, min, max and count of each stage, in order of first use."""
        mean = lambda xs: sum(xs) / len(xs)
        return {
            k: {"avg_ms": round(total / n, 3), "recent_avg_ms": round(mean(self.times[k]), 3), "min_ms": round(least, 3), "max_ms": round(most, 3), "count": n}
            for k, (n, total, least, most) in self.sums.items()
        }
