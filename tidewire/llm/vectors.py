"""Block-wise search of vector tables: shards of candidates, each indexed once, over blocks of queries read from the
shared folder, and the merge of their results.

A shard holds about ``shard_rows`` vectors of one width, dealt by a hash of the row, so that any hot value, label or
repeated id spreads; this shuffle, once over the table, is the only one of vectors. A task indexes its shards, as many as
``held_values`` components at a time, and then goes through the queries' files block by block, each block over all of
its indexes; a query's k-th best score so far goes along to the next index. So an index is made once, no task holds more
than its indexes and a block, and a task gives ``k`` rows for each query. The merge keeps each query's best over all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, lean, store_of

#: (index, query ids, queries, k, k-th best scores so far or None) to (query's row, candidates' ids, scores).
Best = Callable[[dict, np.ndarray, np.ndarray, int, list], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def usable(embeddings: DataFrame, allow_zero: bool = True) -> DataFrame:
    """(vec_id, v): without null ids and without vectors that are null, or hold null or non-finite components (or, on
    demand, are zero). Runs in the JVM."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not allow_zero:
        fine &= F.exists(v, lambda x: x != 0)
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrices(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each width of a column of vectors, in order of rows."""
    width = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.cumsum(width) - width
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        yield ids[rows], flat[starts[rows][:, None] + np.arange(w)].reshape(len(rows), w)


def shards_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shards (ids, vectors) from rows (slot, width, vec_id, v) sorted by (slot, width, vec_id): the rows of a slot and
    width, or ``most`` of them at a time."""
    now, ids, rows, held = None, [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(ids), np.concatenate(rows)

    for batch in batches:
        slot, width, vec = (batch.column(i).to_numpy() for i in range(3))
        at = np.concatenate([[0], np.flatnonzero((slot[1:] != slot[:-1]) | (width[1:] != width[:-1])) + 1, [len(slot)]]) if len(slot) else np.zeros(1, int)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = (slot[s], width[s])
            for a in range(s, e, most):
                b = min(e, a + most)
                if ids and (key != now or held + b - a > most):
                    yield made()
                    ids, rows, held = [], [], 0
                now = key
                (_, x), *_ = matrices(vec[a:b], batch.column(3).slice(a, b - a))
                ids.append(vec[a:b]), rows.append(x)
                held += b - a
    if ids:
        yield made()


def blocks_of(files: list[str], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of queries (ids, vectors), each of one width, from Parquet files in the shared folder."""
    for path in files:
        store, at = store_of(path)
        with store.open_input_file(at) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=rows, columns=["vec_id", "v"]):
                yield from matrices(batch.column(0).to_numpy(), batch.column(1))


class Merged:
    """The best ``k`` of each query of a block, ties to smaller ids; scores that are better come first."""

    def __init__(self, queries: int, k: int, largest: bool, kind: type) -> None:
        self.k, self.largest = k, largest
        self.ids = [np.zeros(0, np.int64)] * queries
        self.scores = [np.zeros(0, kind)] * queries
        self.last: list = [None] * queries  # the k-th best, when there are so many

    def add(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        ids, scores = np.concatenate([self.ids[row], ids]), np.concatenate([self.scores[row], scores])
        # ~x turns an integer's order round without leaving its range
        order = np.lexsort((ids, (~scores if scores.dtype.kind == "i" else -scores) if self.largest else scores))[: self.k]
        self.ids[row], self.scores[row] = ids[order], scores[order]
        if len(order) == self.k:
            self.last[row] = self.scores[row][-1].item()


def search(spark: SparkSession, vectors: DataFrame, most_rows: int, every: int, k: int, index: Callable[[np.ndarray, np.ndarray], dict], best: Best, kind: str, largest: bool, shard_rows: int, block_rows: int, held_values: int = 1 << 22) -> DataFrame:
    """(query_id, rank, vec_id, score). ``vectors`` has at most ``most_rows`` rows. ``index`` makes a shard's index of ids
    and vectors; ``best`` yields (query's row, candidates' ids, scores) for a block of queries, without the query's own
    vec_id. Queries are the rows whose vec_id is divisible by ``every``."""
    n_files = max(1, -(-most_rows // (every * 8 * block_rows)))
    asked = cut(spark, vectors.where(F.pmod("vec_id", F.lit(every)) == 0).repartition(n_files, "vec_id", F.xxhash64("v")), "queries")
    files = asked.inputFiles()
    slots = max(1, -(-most_rows // shard_rows))
    slot = F.pmod(F.xxhash64("vec_id", "v", F.lit("shard")), F.lit(slots)).cast("int")
    tasks = min(slots, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = vectors.select(slot.alias("slot"), F.size("v").alias("width"), "vec_id", "v").repartition(tasks, "slot").sortWithinPartitions("slot", "width", "vec_id")
    kind_of = (pa.int64(), np.int64) if kind == "long" else (pa.float64(), np.float64)

    def found(indexes: list[tuple[int, dict]]) -> Iterator[pa.RecordBatch]:
        for qids, q in blocks_of(files, block_rows):
            mine = [made for width, made in indexes if width == q.shape[1]]
            if not mine:
                continue
            merged = Merged(len(qids), k, largest, kind_of[1])
            for made in mine:
                for row, ids, scores in best(made, qids, q, k, merged.last):
                    merged.add(row, ids, scores)
            sizes = [len(i) for i in merged.ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate(merged.ids)), pa.array(np.concatenate(merged.scores), kind_of[0])], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: list[tuple[int, dict]] = []
        held = 0
        for ids, x in shards_of(batches, 2 * shard_rows):
            if indexes and held + x.size > held_values:
                yield from found(indexes)
                indexes, held = [], 0
            indexes.append((x.shape[1], index(ids, x)))
            held += x.size
        if indexes:
            yield from found(indexes)

    order = W.partitionBy("query_id").orderBy(F.col("score").desc() if largest else F.col("score").asc(), "vec_id")
    out = dealt.mapInArrow(lean(run), f"query_id long, vec_id long, score {kind}")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
