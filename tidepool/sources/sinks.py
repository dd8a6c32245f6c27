"""Sinks: stage dumps, state as JSON, rendered slots, dictionary appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings


def stages(messages: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Every stage of the offline batch by name: kept and filtered messages, what each stage made of them, and the frequencies."""
    from ..operators import pipeline, registry

    split = pipeline.cleansed(messages, settings)
    made = pipeline.canonical(messages, settings)
    date = F.date_format("ts", "yyyy-MM-dd").alias("date")
    when = ["seq", date, "ts"]
    step = lambda now, before: made.select(*when, F.col(now).alias("message"), F.col(before).alias("before"))
    first = made.groupBy("canonical").agg(F.min_by("ts", "seq").alias("first_ts"))
    counted = registry.registry(made).join(first, "canonical")
    ranked = counted.select(F.row_number().over(Window.orderBy(F.desc("n"), "first_seq")).alias("rank"), F.col("canonical").alias("text"), F.col("n").alias("count"), F.date_format("first_ts", "yyyy-MM-dd").alias("first_date"))
    return {
        "step1_kept": made.select(*when, F.col("cleaned").alias("message"), F.col("raw_text").alias("original")),
        "step1_filtered": split.filter("filtered").select(*when, F.col("raw_text").alias("message"), F.lit("filtered").alias("reason")),
        "step2_normalized": step("normalized", "cleaned"),
        "step3_compressed": step("compressed", "normalized"),
        "step4_simhash": step("canonical", "compressed"),
        "step5_changed": made.filter("raw_text <> canonical").select(*when, F.col("canonical").alias("message"), F.col("raw_text").alias("before")),
        "step6_dedup": registry.layers(made).join(made.select(*when, F.col("canonical").alias("message")), "seq").select("seq", "date", "ts", "message", (F.col("layer") == 3).alias("is_new_unique")),
        "step6_frequencies": ranked,
    }


def dump_stages(messages: DataFrame, folder: str, settings: Settings = Settings()) -> list[str]:
    """Write every stage as CSV with a header below folder; the names written."""
    named = stages(messages, settings)
    for name, frame in named.items():
        frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    return list(named)


def rendered(slots: DataFrame) -> DataFrame:
    """Slots as lines of a terminal table, hot ones first, then by falling count."""
    line = F.format_string("%-3s %-6s %6d  %-24s %s", "tier", "cluster_id", "total_count", F.substring("canonical_text", 1, 24), F.array_join("top_keywords", " "))
    # a global sort reads its input twice, first for a sample: the second time from this exchange and not by another fold
    lines = slots.select("stream", "tier", "total_count", "slot_ord", line.alias("line")).repartition("stream")
    return lines.orderBy("stream", F.desc("tier"), F.desc("total_count"), "slot_ord").select("stream", "line")


def append_variants(spark: SparkSession, pairs: DataFrame, path: str) -> None:
    """Add confirmed (variant, canonical) pairs that the table at path lacks."""
    try:
        known = spark.read.parquet(path)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = pairs.limit(0)
    pairs.select("variant", "canonical").join(known, ["variant", "canonical"], "left_anti").write.mode("append").parquet(path)
