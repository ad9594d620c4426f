"""Appending batches to the stored articles: unions of tables with different columns, and keep-last deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("titulo", "contenido")


def union_outer(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; a column that one side lacks is null there."""
    return old.unionByName(new, allowMissingColumns=True)


def key_hash(keys: tuple[str, ...] = KEY) -> Column:
    """128 bits of a row's key, null-safe: articles are compared by it, so that no text is sorted or shuffled twice."""
    packed = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    return F.md5(packed)


def dedup_keep_last(df: DataFrame, order: str = "doc_idx", keys: tuple[str, ...] = KEY) -> DataFrame:
    """Of rows with equal keys the last in ``order``; nulls are equal. ``order`` should be unique.

    The last position of each key is found by an aggregate of two narrow columns, with partial sums before the shuffle
    (a key with a third of all rows is no burden); the winners are then joined back on the position, which is unique,
    so no key's rows meet in one task."""
    last = df.select(key_hash(keys).alias("__key"), F.col(order)).groupBy("__key").agg(F.max(order).alias(order)).select(order)
    return df.join(last, order, "left_semi")


def append_keep_last(old: DataFrame | None, new: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """A batch after the stored rows: the newest of equal rows wins, survivors keep their order, ``doc_idx`` is
    assigned anew by the caller from ``__order``. A first batch is not deduplicated."""
    if old is None:
        return new.withColumn("__order", F.struct(F.lit(1).alias("batch"), F.col("doc_idx").alias("pos")))
    both = union_outer(old.withColumn("__batch", F.lit(0)), new.withColumn("__batch", F.lit(1)))
    both = both.withColumn("__order", F.struct(F.col("__batch").alias("batch"), F.col("doc_idx").alias("pos"))).drop("__batch")
    return dedup_keep_last(both, "__order", keys)


def dedup_window(df: DataFrame, order: str = "doc_idx", keys: tuple[str, ...] = KEY) -> DataFrame:
    """The same by a window over the keys; plainer, but a hot key's rows meet in one task. For small tables."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("__rank", last).where("__rank = 1").drop("__rank")
