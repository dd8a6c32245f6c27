"""Sources of messages and dictionaries; every schema is stated, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dictionaries

MESSAGE = "msg_id string, stream string, seq long, ts timestamp, raw_text string"


#: Up to so many bytes an input is dealt to all cores; larger ones have row groups enough.
SMALL_INPUT = 128 << 20


def spread(frame: DataFrame) -> DataFrame:
    """A small input, which may lie in a single row group, dealt to all cores; a larger one as it is."""
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else frame


#: Places of a document or conversation that have a seq of their own; a product that does not fit is an error.
PLACES = 1 << 28


def _placed(parent: Column, place: Column) -> list[Column]:
    """seq, in the order of parents and places, and ts, a second for each parent."""
    inside = F.when(place < PLACES, place).otherwise(F.raise_error(F.lit(f"more than {PLACES} messages in one parent")).cast("long"))
    seq = parent.cast("long") * PLACES + inside
    return [seq.cast("string").alias("msg_id"), seq.alias("seq"), F.timestamp_micros(parent.cast("long") * 1_000_000 + place).alias("ts")]


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each line of ``documents``, in order of document and line; the language is the stream."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "raw_text"))
    named = lines.select(*_placed(F.col("doc_id"), F.col("pos").cast("long")), F.col("lang").alias("stream"), "raw_text")
    return named.select("msg_id", "stream", "seq", "ts", "raw_text")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    named = turns.select(*_placed(F.col("conv_id"), F.col("turn").cast("long")), F.col("role").alias("stream"), F.col("text").alias("raw_text"))
    return named.select("msg_id", "stream", "seq", "ts", "raw_text")


def replay_csv(spark: SparkSession, path: str, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """A header CSV (message, timestamp in ms, date): blanks trimmed, empty messages dropped, cut to limit, then ordered by time."""
    rows = spark.read.schema("message string, timestamp string, date string").option("header", True).option("encoding", "UTF-8").option("escape", '"').option("enforceSchema", False).csv(path)
    rows = rows.select(F.trim("message").alias("raw_text"), F.timestamp_millis(F.coalesce(F.expr("try_cast(timestamp as bigint)"), F.lit(0))).alias("ts"), F.coalesce("date", F.lit("")).alias("date"))
    rows = rows.filter("raw_text <> ''")
    rows = rows.limit(limit) if limit else rows
    return rows.orderBy("ts") if ordered else rows


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file, one message for each line that is not blank."""
    return spark.read.text(path).select(F.trim("value").alias("raw_text")).filter("raw_text <> ''")


def json_events(events: DataFrame, column: str = "value") -> DataFrame:
    """Messages among JSON events: those of type "message" whose message is not empty."""
    parsed = events.select(F.from_json(column, "type string, message string").alias("e"))
    return parsed.filter("e.type = 'message' and e.message <> ''").select(F.col("e.message").alias("raw_text"))


def query_string(urls: DataFrame, column: str, name: str = "text") -> DataFrame:
    """Messages sent as a parameter of a request's address; empty ones are ignored."""
    text = F.expr(f"try_url_decode(replace(parse_url({column}, 'QUERY', '{name}'), '+', '%20'))")
    return urls.select(text.alias("raw_text")).filter("raw_text <> ''")


def variants(spark: SparkSession, entries: list[tuple[str, str]] | None = None) -> DataFrame:
    """variant and canonical; of a variant that is listed twice the last one holds."""
    rows = [(v, c, i) for i, (v, c) in enumerate(dictionaries.entries() if entries is None else entries)]
    listed = spark.createDataFrame(rows, "variant string, canonical string, ord int")
    return listed.groupBy("variant").agg(F.max_by("canonical", "ord").alias("canonical"))


def variants_yaml(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(variant, canonical) of a dictionary file ``variants: {canonical: [variant, ...]}``, in order of listing."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    listed = (yaml.safe_load(text.value) or {}).get("variants") or {} if text else {}
    return [(str(v), str(c)) for c, vs in listed.items() for v in vs or []]


def variants_json(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded dictionary {variant: canonical}; variants in lower case."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("variant", "canonical"))
    return text.select(F.lower("variant").alias("variant"), "canonical")


def variants_over(base: DataFrame, upload: DataFrame) -> DataFrame:
    """variant and canonical of a dictionary with an upload laid over it: what the upload has holds."""
    both = base.select("variant", "canonical", F.lit(0).alias("ord")).union(upload.select("variant", "canonical", F.lit(1)))
    return both.groupBy("variant").agg(F.max_by("canonical", F.struct("ord", "canonical")).alias("canonical"))
