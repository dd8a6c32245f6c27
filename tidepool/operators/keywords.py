"""Keywords of messages and of groups of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .ordered import previous


def keywords(messages: DataFrame, top: int = 5) -> DataFrame:
    """seq, stream and keywords: the most frequent tokens of the raw text, ties by first place."""
    words = messages.select("seq", "stream", F.posexplode(tx.tokens(F.col("raw_text"))).alias("pos", "word")).filter(tx.is_keyword(F.col("word")))
    counted = words.groupBy("seq", "stream", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("seq", "stream").orderBy(F.desc("n"), "pos"))).filter(F.col("rank") <= top)
    return ranked.groupBy("seq", "stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))


def signature(keywords: DataFrame, group: str, top: int = 5) -> DataFrame:
    """The keywords that most messages of a group have, with how many; ties by word."""
    counted = keywords.select(group, F.explode("keywords").alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "word")))
    return ranked.filter(F.col("rank") <= top).select(group, "word", "n", F.col("rank").cast("long").alias("rank"))


def neighbour_similarity(keywords: DataFrame) -> DataFrame:
    """seq and the Jaccard similarity of a message's keywords with those of the one before it in its stream."""
    met = previous(keywords.select("stream", "seq", "keywords"), "stream", "seq", "keywords", "before")
    return met.select("seq", F.round(tx.jaccard(F.col("keywords"), F.col("before")), 6).alias("jaccard"))
