"""Schemas of the article tables, and the row position ``doc_idx``.

Paging, search order and the neighbour column refer to an article's position, so every table carries a contiguous
``doc_idx`` from 0 that is assigned once, at ingestion. Spark has no row order of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sources.scratch import written

RAW_FIELDS = ("titulo", "contenido", "enlace", "fuente", "fecha")
UNDETERMINED, YES, NO = "No determinado", "Si", "No"

ARTICLES = T.StructType([T.StructField(c, T.StringType()) for c in RAW_FIELDS] + [T.StructField("cluster", T.IntegerType()), T.StructField("menores_identificados", T.StringType())])
ANALYZED = T.StructType(
    [
        *ARTICLES.fields,
        T.StructField("titulo_limpio", T.StringType()),
        T.StructField("contenido_limpio", T.StringType()),
        T.StructField("topic_id", T.IntegerType()),
        T.StructField("topic_probability", T.DoubleType()),
        T.StructField("topic_description", T.StringType()),
        T.StructField("most_similar_doc_idx", T.IntegerType()),
        T.StructField("max_similarity", T.DoubleType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType = ARTICLES, extra: tuple[str, ...] = ("doc_idx",)) -> DataFrame:
    """``schema``'s columns in its order, absent ones as typed nulls, then those of ``extra`` that are there."""
    columns: list[Column] = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*columns, *[c for c in extra if c in df.columns])


def with_doc_idx(df: DataFrame, *order: Column | str) -> DataFrame:
    """Numbers the rows 0, 1, ... in ``order``: a range partitioning, a sort in each partition and the partitions' row
    counts (one number each on the driver), never all rows in one task. The sorted partitions are written to the shared
    folder, so that a lost executor can't renumber them. ``order`` should be unique for a result that reruns agree on."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the position within a partition is the low 33 bits of Spark's own id, the partition's number the bits above
    marked = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    marked = written(marked, "positions")
    part = F.shiftright("__id", 33)
    counts = {r[0]: r[1] for r in marked.groupBy(part.alias("p")).count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), (part + 1).cast("int"))
    return marked.withColumn("doc_idx", start + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """Articles from a table of plain documents: the first line is the title."""
    return documents.select(
        F.col("doc_id").alias("doc_idx"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("titulo"),
        F.col("text").alias("contenido"),
        F.lit("").alias("enlace"),
        F.col("source").alias("fuente"),
        F.lit(None).cast("string").alias("fecha"),
        F.lit(0).alias("cluster"),
        F.lit(UNDETERMINED).alias("menores_identificados"),
    )
