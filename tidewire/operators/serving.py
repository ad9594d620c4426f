"""What the service answers, as functions over an articles table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import YES
from .search import records


def stats_frame(df: DataFrame) -> DataFrame:
    """One row, one pass: totals, numbers of clusters and topics, mean similarity."""

    def or_zero(c: str, agg):
        return F.coalesce(agg, F.lit(0)) if c in df.columns else F.lit(0)

    return df.agg(
        F.count("*").alias("total_noticias"),
        F.count_if(F.col("menores_identificados") == YES).alias("noticias_nna"),
        or_zero("cluster", F.countDistinct("cluster") if "cluster" in df.columns else None).cast("long").alias("clusters"),
        or_zero("topic_id", F.countDistinct("topic_id") if "topic_id" in df.columns else None).cast("long").alias("topics"),
        or_zero("max_similarity", F.avg("max_similarity") if "max_similarity" in df.columns else None).cast("double").alias("similitud_promedio"),
    )


def stats(df: DataFrame) -> dict:
    return {**stats_frame(df).first().asDict(), "ultima_actualizacion": datetime.now().isoformat()}


def flag_percentage(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return df.agg(F.when(n > 0, F.count_if(F.col("menores_identificados") == YES) / n * 100).otherwise(0.0).alias("percentage"))


def flagged(df: DataFrame) -> DataFrame:
    return df.where(F.col("menores_identificados") == YES)


def page_rows(df: DataFrame, page: int = 1, per_page: int = 10, only_flagged: bool = False) -> DataFrame:
    """A page in row order. Pages before the first are empty. Unflagged pages are a range of doc_idx, which a scan can
    skip to by the file's statistics; flagged ones a top-k."""
    if per_page < 1:
        raise ValueError("per_page must be 1 or more")
    start = (page - 1) * per_page
    if page < 1:
        return df.limit(0)
    if only_flagged:
        return flagged(df).orderBy("doc_idx").offset(start).limit(per_page)
    return df.where((F.col("doc_idx") >= start) & (F.col("doc_idx") < start + per_page)).orderBy("doc_idx")


def page(df: DataFrame, page: int = 1, per_page: int = 10, only_flagged: bool = False) -> dict:
    total = (flagged(df) if only_flagged else df).count()
    rows = records(page_rows(df, page, per_page, only_flagged)).collect()
    return {"noticias": [r.asDict() for r in rows], "total": total, "page": page, "per_page": per_page, "total_pages": -(-total // per_page)}


def health(df: DataFrame | None) -> dict:
    return {"status": "healthy", "timestamp": datetime.now().isoformat(), "data_loaded": df is not None, "data_size": df.count() if df is not None else 0}
