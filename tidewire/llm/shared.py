"""Helpers that every operator of the subpackage uses: the shared folder, bounded samples, Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in the contracts of this subpackage, and what makes one.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = f"[^{SPACE_CLASS}]+"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Only where that is unset (tests on
    one machine) a temporary folder is taken, one for each application."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not getattr(spark.sparkContext, "master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no folder")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        at = _own[app]
    return at.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidewire/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written into the shared folder; results not yet read are lost."""
    delete(spark, application_dir(spark))


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    at = new_path(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._tidewire_path = at
    return out


def drop_cut(spark: SparkSession, df: DataFrame | None) -> None:
    """Deletes what :func:`cut` wrote, when nothing reads it any more."""
    at = getattr(df, "_tidewire_path", None)
    if at:
        delete(spark, at)


def store_of(path: str):
    """(file system, path in it) of a path in the shared folder, for work that isn't Spark's own reading and writing."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column | str, mod: int) -> Column:
    """crc32 of an id's decimal text, modulo ``mod``; null ids count as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % mod


#: Hashes that sampling compares are 62 bits wide.
HASH_BITS = 62


def sample_threshold(bound: int, count: int) -> int:
    """Hashes below this make about ``bound`` of ``count`` rows; all, if there are fewer. Never 0 for a bound above 0:
    a count would have to exceed 2^62 rows."""
    return 1 << HASH_BITS if count <= bound else max(1, (bound << HASH_BITS) // count)


def sample_thresholds(counts: list[tuple], bound: int) -> list[tuple]:
    """(class, threshold) of each (class, count)."""
    return [(*c[:-1], sample_threshold(bound, c[-1])) for c in counts]


def bounded_sample(rows: DataFrame, key: str, by: list[str], bound: int, most_classes: int = 256) -> DataFrame:
    """About ``bound`` rows for each combination of ``by`` (all, if there are fewer), chosen by a hash of ``key``:
    deterministic and without a sort. Only the ``most_classes`` most frequent combinations (ties: the smaller first) have
    rows in the sample, so that their counts, which go to the driver, and the sample are bounded. ``rows`` should be
    narrow; rows with a null in ``by`` are left out."""
    known = rows.dropna(subset=by)
    counts = known.groupBy(*by).count().orderBy(F.desc("count"), *by).limit(most_classes).collect()
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    below = rows.sparkSession.createDataFrame(sample_thresholds([tuple(r) for r in counts], bound), f"{kinds}, __below long")
    salted = F.xxhash64(F.col(key).cast("string"), F.lit("sample")).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    return known.join(F.broadcast(below), by).where(salted < F.col("__below")).select(*rows.columns)


def one_text_each(docs: DataFrame, chosen: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, more) for each doc_id of ``chosen``, a table that a sample's bound keeps small: of several rows with
    one doc_id the one with the smallest hash of its text, so that repeated ids can't exceed the bound."""
    rows = docs.select("doc_id", "text", *more).join(F.broadcast(chosen), "doc_id")
    extra = [c for c in rows.columns if c not in ("doc_id", "text")]
    first = F.min(F.struct(F.xxhash64("text").alias("__hash"), "text", *extra)).alias("__first")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "__first.text", *[f"__first.{c}" for c in extra])


def plain_texts(column: pa.Array) -> pa.LargeStringArray:
    """Any string column with 64-bit offsets; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch of texts into runs of whole texts with about ``most`` bytes (a longer text stands alone):
    (first row, row after the last, bytes, offsets from 0)."""
    texts = plain_texts(column)
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, for mapInArrow; at a task's end the worker, which lives on for later tasks, gives
    the memory that it no longer uses back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is no such call outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each byte, the number of the text that it is in."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
