"""Feeds as a stream: landed XML files become articles, and every batch is merged into the stored table, the newest of
equal articles winning. Keeping the last is a change to a table, not a watermark's work, so it is done batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.detect import detect
from ..operators.history import append_keep_last
from ..schema import conform, with_doc_idx
from ..sources.feeds import ITEM, to_articles
from ..sources.scratch import written
from ..sources.tables import load, publish


def item_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("xml").option("rowTag", "item").schema(ITEM)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    about = [F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_block_start")]
    return reader.load(folder).select("*", F.col("_metadata.file_path").alias("feed"), F.struct(*about).alias("landed"))


def merge(batch: DataFrame, path: str, *order: str) -> None:
    """Appends a batch of articles, in ``order``, to the table at ``path`` and publishes it. Running it again with the same
    batch changes nothing but positions, so a batch that is delivered twice does no harm. The whole table is rewritten."""
    old = load(batch.sparkSession, path)
    placed = batch.withColumnRenamed("doc_idx", "__at")
    fresh = conform(with_doc_idx(placed, *["__at" if o == "doc_idx" else o for o in order]))
    merged = append_keep_last(old, fresh).drop("doc_idx")
    publish(with_doc_idx(merged, "__order").drop("__order"), path)


def upsert_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, every: str | None = None, files_per_trigger: int | None = None, exact: bool = True) -> StreamingQuery:
    """All that has landed so far (the default), or, with ``every`` such as '6 hours', on and on. ``exact`` as in strip_html."""
    items = item_stream(spark, folder, files_per_trigger)
    articles = to_articles(items, exact).withColumn("menores_identificados", detect("contenido"))

    def each(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        # an item's place: its file's time and name, the part of the file, the place in it; the last is fixed by writing
        placed = written(conform(batch, extra=("landed",)).withColumn("place", F.monotonically_increasing_id()), "batch")
        keys = placed.withColumns({"__time": F.col("landed.file_modification_time"), "__block": F.col("landed.file_block_start")}).drop("landed")
        merge(keys, path, "__time", "fuente", "__block", "place")

    writer = articles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
