"""What depends on the order of a long stream, in two steps: inside stretches of bounded length, and from stretch to stretch.

A window over a whole stream, or over a text that a third of all messages have, would be one task.  Here the rows
of a key are dealt to stretches of its order; what crosses from one stretch to the next is a small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the order that one stretch spans.
STRETCH = 1 << 34


def _stretch(order: str, span: int) -> Column:
    return F.floor(F.col(order) / F.lit(span)).cast("long")


def previous(rows: DataFrame, key: str, order: str, value: str, name: str, span: int = STRETCH) -> DataFrame:
    """rows with name, the value of the row before in its key; the first row of a key, which has none, is left out."""
    dealt = rows.withColumn("__stretch", _stretch(order, span))
    last = dealt.groupBy(key, "__stretch").agg(F.max_by(F.struct(value), order).alias("__last"))
    carried = last.select(key, "__stretch", F.lag("__last").over(Window.partitionBy(key).orderBy("__stretch")).alias("__carried"))
    inside = Window.partitionBy(key, "__stretch").orderBy(order)
    held = dealt.withColumn("__prior", F.lag(F.struct(value)).over(inside)).join(carried, [key, "__stretch"])
    found = held.withColumn("__prior", F.coalesce("__prior", "__carried")).filter("__prior is not null")
    return found.withColumn(name, F.col("__prior")[value]).drop("__prior", "__carried", "__stretch")


def count_before(rows: DataFrame, key: str, order: str, name: str, span: int = STRETCH) -> DataFrame:
    """rows with name, how many rows of the key come before."""
    dealt = rows.withColumn("__stretch", _stretch(order, span))
    sizes = dealt.groupBy(key, "__stretch").agg(F.count("*").alias("__size"))
    so_far = Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(key, "__stretch", F.coalesce(F.sum("__size").over(so_far), F.lit(0)).alias("__carried"))
    inside = Window.partitionBy(key, "__stretch").orderBy(order)
    held = dealt.withColumn(name, F.row_number().over(inside) - 1).join(carried, [key, "__stretch"])
    return held.withColumn(name, (F.col(name) + F.col("__carried")).cast("long")).drop("__carried", "__stretch")
