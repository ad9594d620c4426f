"""Stored tables: CSV as other tools write it, Parquet as the native form, and the JSON of a run."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ANALYZED, YES

#: The file that says that a new table is whole.
COMPLETE = "_COMPLETE"
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}
VERSION = "tidewire_v1"
ALGORITHMS = ["TF-IDF", "LDA", "K-Means", "Cosine similarity"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Columns by header name, typed as in ``schema`` (the analysed article by default); empty fields are null."""
    text = spark.read.options(**CSV).csv(path)
    kinds = {f.name: f.dataType for f in (schema or ANALYZED)}
    # numbers may have been written as doubles, whatever the column's type
    return text.select(*[(F.col(c).try_cast("double").cast(kinds[c]) if isinstance(kinds.get(c), (T.IntegerType, T.LongType)) else F.col(c).try_cast(kinds[c].simpleString()) if c in kinds else F.col(c)).alias(c) for c in text.columns])


def _hadoop(spark: SparkSession, path: str):
    """(file system, path as Hadoop has it)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def recover(spark: SparkSession, path: str) -> None:
    """Ends a publication that was cut short: a finished new table goes in, else the old one comes back. The old table is
    deleted only when there is one at ``path``."""
    fs, here = _hadoop(spark, path)
    _, new = _hadoop(spark, f"{path}.new")
    _, gone = _hadoop(spark, f"{path}.old")
    if not fs.exists(here):
        for from_ in ([new] if fs.exists(_hadoop(spark, f"{path}.new/{COMPLETE}")[1]) else []) + [gone]:
            if fs.exists(from_) and fs.rename(from_, here):
                break
    if fs.exists(here):
        fs.delete(gone, True)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None if there is none. One that is there but can't be read raises."""
    recover(spark, path)
    fs, here = _hadoop(spark, path)
    if not fs.exists(here):
        return None
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header. ``single`` writes one file at ``path`` itself (for exports that a person downloads; it goes
    through one task), else a folder of part files."""
    writer = (df.coalesce(1) if single else df).write.mode("overwrite").options(header="true", quote='"', escape='"', emptyValue="")
    if not single:
        writer.csv(path)
        return
    writer.csv(f"{path}.parts")
    spark = df.sparkSession
    fs, parts = _hadoop(spark, f"{path}.parts")
    _, here = _hadoop(spark, path)
    part = next(f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-"))
    fs.delete(here, True)
    if not fs.rename(part, here):
        raise OSError(f"{path} can't be written")
    fs.delete(parts, True)
    _, check = _hadoop(spark, os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    fs.delete(check, False)  # a local file system's checksum of the file that was there before


def publish(df: DataFrame, path: str) -> None:
    """Parquet written beside ``path`` and swapped in by two renames, so that a table may be rewritten from itself. At
    every moment the old or the finished new table is whole, and :func:`recover`, which ``load`` and the next publication
    begin with, puts it back in place; a plain reader between the two renames finds none. One writer at a time."""
    spark = df.sparkSession
    recover(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs, here = _hadoop(spark, path)
    fs.create(_hadoop(spark, f"{path}.new/{COMPLETE}")[1], True).close()
    if fs.exists(here) and not fs.rename(here, _hadoop(spark, f"{path}.old")[1]):
        raise OSError(f"{path} can't be moved")
    recover(spark, path)
    spark.catalog.refreshByPath(path)


def metadata(df: DataFrame) -> dict:
    total, flagged = df.agg(F.count("*"), F.count_if(F.col("menores_identificados") == YES)).first()
    return {"total_noticias": total, "noticias_con_nna": flagged, "columnas_disponibles": [c for c in df.columns if c != "doc_idx"], "version": VERSION, "algoritmos_usados": ALGORITHMS}


def save_results(df: DataFrame, path: str) -> dict:
    """The analysed table as one CSV, and its metadata as JSON beside it."""
    columns = [c for c in df.columns if c != "doc_idx"]
    write_csv(df.orderBy("doc_idx").select(*columns) if "doc_idx" in df.columns else df, path, single=True)
    about = metadata(df)
    with open(f"{os.path.splitext(path)[0]}_metadata.json", "w", encoding="utf-8") as f:
        json.dump(about, f, ensure_ascii=False, indent=2)
    return about
