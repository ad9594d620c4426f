"""SimHash near-duplicates: a segment-popcount embedding, a grid range-join under the Manhattan distance, then exact
verification.

A fingerprint is mapped to the bit counts of 32 segments of 2 bits. The Manhattan distance of two such vectors is at
most the Hamming distance of the fingerprints, so that a link (3 or fewer differing bits) lies within Manhattan radius
3. The grid: the 32 coordinates fall into 7 axes groups; coordinates that differ touch at most 3 groups, so that two
vectors within the radius have the same cell in the sub-grid of at least one choice of 4 groups (35 sub-grids, one key
each). Inside a cell the Manhattan bound is tested, then the Hamming distance.

``prints`` fingerprints of a text, from independently mixed shingle hashes (the first is the hash itself), may be taken;
documents link if any of them does. One is what op8's contract asks for.

The pipeline's stage (:func:`similar_texts`) links texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more, whatever their fingerprints. Candidates are op8's links and texts that share one of BANDS keys of ROWS
minima each (a pair at 0.8 shares none with probability 3e-6), if LEAST_EQUAL of their minima agree at least; every
candidate is confirmed on the exact sets. That is done in two steps, so that a large group doesn't give all its pairs:
first every text of a bucket meets the bucket's first text only; the links found give components; then the buckets that
still hold several components get their texts' sets, and the texts of different components are compared within the task,
which gives one link for each two components that it joins. A pair within a component can't change the result.

Only different fingerprints are joined (copies collapse first). A cell gives a spanning forest of its links, not all
pairs; a cell with more than ``tile`` fingerprints is dealt out as pairs of blocks, so that no task gathers it whole.
Every pair within the radius shares a cell, and a forest has the components of all links: nothing is lost.

Defined results: null texts count as empty; texts without words have fingerprint zero and link like any other; null
doc_ids are left out of op8; repeated doc_ids give a row each. Extra columns of the input are kept out. The stage decides
by row, not by doc_id: of a group's rows the one with the smallest doc_id stays (null ids last, then by a hash of the text),
also where rows are equal in all columns or one doc_id has several texts; texts without words are one group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .cuts import ragged
from .shared import WORD, cut, lean, plain_texts, table

RADIUS = 3
GROUPS = 7
KEEP = GROUPS - RADIUS
FIND_WORDS = re.compile(WORD.encode()).findall


def mixed(h: np.ndarray, t: int) -> np.ndarray:
    """Hash t of each hash: itself for 0, else the finaliser of a well-known generator (fixed values)."""
    if t == 0:
        return h
    x = h + np.uint64(t * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Hashes of each ``size`` words in a row (of all words, if there are fewer), in runs."""
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    last = ends[size - 1 :] or ends[-1:]  # fewer words: the whole sequence
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        yield np.array([digest(joined[s:e], 42) for s, e in zip(starts[a:b], last[a:b], strict=True)], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return FIND_WORDS(text.lower())  # bytes.lower() changes A-Z only


def fingerprint(words: list[bytes], size: int = 3, prints: int = 1) -> np.ndarray:
    """The fingerprints of one text's words."""
    if not words:
        return np.zeros(prints, np.uint64)
    n = max(1, len(words) - size + 1)
    counts = np.zeros((prints, 64), np.int64)
    for h in shingles(words, size):
        for t in range(prints):
            counts[t] += np.unpackbits(mixed(h, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, size: int = 3, prints: int = 1) -> DataFrame:
    """(doc_id, fps): fps are the fingerprints' 64 bits as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(words_of(t.as_buffer().to_pybytes()), size, prints) for t in plain_texts(batch.column(1))]
            flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * prints, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fps"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, fps array<long>")


# --- the embedding and its grid ------------------------------------------------------------------------------------

_LOW = np.uint64(0x5555555555555555)
#: Segment k (bits 2k and 2k + 1) belongs to group k mod GROUPS; a choice of groups is a mask over the embedding.
_GROUP = [sum(3 << 2 * k for k in range(32) if k % GROUPS == g) for g in range(GROUPS)]
CHOICES = [sum(_GROUP[g] for g in chosen) for chosen in combinations(range(GROUPS), KEEP)]


def embed(fp: np.ndarray) -> np.ndarray:
    """The 32 bit counts (0 to 2), two bits each, in one word."""
    return (fp & _LOW) + (fp >> np.uint64(1) & _LOW)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the coordinates' absolute differences of packed embeddings."""
    high = _LOW << np.uint64(1)
    # |x - y| of counts 0..2: with x ^ y = 3 only for {1, 2}, whose difference is 1; else the difference is x ^ y
    d = a ^ b
    ones, twos = d & _LOW, d & high
    return np.bitwise_count(ones).astype(np.int64) + 2 * np.bitwise_count(twos & ~(ones << np.uint64(1)))


def _keys(each: DataFrame) -> DataFrame:
    """(key, fp, doc_id): a row for each sub-grid. Runs in the JVM."""
    fp = F.col("fp")
    even = fp.bitwiseAND(F.lit(int(_LOW)))
    odd = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(int(_LOW)))
    cells = F.array(*[F.xxhash64(F.col("e").bitwiseAND(F.lit(int(np.uint64(m).view(np.int64)))), F.lit(k), F.col("print")) for k, m in enumerate(CHOICES)])
    counts = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))  # a sum of 2 bits each
    return each.withColumn("e", counts).select(F.explode(cells).alias("key"), "fp", "doc_id")


def _forest(fp: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that span the components of one cell."""
    e, left = embed(fp), np.arange(len(fp))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = left[manhattan(e[left], e[i]) <= RADIUS]
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= RADIUS]
            if len(near):
                yield from ((int(doc[i]), int(doc[j])) for j in near)
                front += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, part): links within each run of equal keys, which may go on in the next batch."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

    def linked(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, part, fp, doc = columns
        fp = fp.view(np.uint64)
        found: list[tuple[int, int]] = []
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]])) if len(key) else np.zeros(1, np.int64)
        size = np.diff(at)
        two = at[:-1][size == 2]
        near = two[manhattan(embed(fp[two]), embed(fp[two + 1])) <= RADIUS] if len(two) else two
        near = near[np.bitwise_count(fp[near] ^ fp[near + 1]) <= RADIUS] if len(near) else near
        a, b = doc[near], doc[near + 1]
        for s, n in zip(at[:-1][size > 2], size[size > 2], strict=True):
            found.extend(_forest(fp[s : s + n], doc[s : s + n]))
        if found:
            more = np.array(found, np.int64)
            a, b = np.concatenate([a, more[:, 0]]), np.concatenate([b, more[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, batch.columns, strict=True)]
        if not len(columns[0]):
            continue
        last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        begin = int(last[-1]) + 1 if len(last) else 0
        rest = [c[begin:] for c in columns]
        if begin:
            yield linked([c[:begin] for c in columns])
    yield linked(rest)


def _dealt(spark: SparkSession, keys: DataFrame, by: str, tile: int) -> DataFrame:
    """(key, part, ``by``, the rest): a key with more than ``tile`` rows is dealt out as pairs of blocks."""
    rest = [c for c in keys.columns if c not in ("key", by)]
    hot = keys.groupBy("key").count().where(F.col("count") > tile)
    hot = cut(spark, hot.select("key", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("blocks")), "hot-cells")
    if not hot.limit(1).count():
        return keys.select("key", F.lit(0).cast("long").alias("part"), by, *rest)
    # a hot cell's rows go to blocks by a hash, and each pair of blocks is a part of its own
    keys = keys.join(hot, "key", "left")
    block = F.pmod(F.xxhash64(by, F.lit("block")), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = keys.withColumn("block", F.coalesce(block, F.lit(0))).withColumn("other", other)
    part = F.when(F.col("other") < 0, F.lit(0)).otherwise(F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other")).cast("long")
    return keys.select("key", part.alias("part"), by, *rest)


def links(spark: SparkSession, each: DataFrame, tile: int = 4096) -> DataFrame:
    """(a, b): links between different fingerprints that span the components. ``each`` has one row for each
    fingerprint: print (its number), fp and doc_id."""
    keys = _dealt(spark, _keys(each), "fp", tile)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(lean(_links), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 3, prints: int = 1) -> DataFrame:
    """(doc_id, fps, component_id)."""
    fps = cut(spark, fingerprints(docs, size, prints), "fingerprints")
    nodes = cut(spark, fps.groupBy("fps").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    single = nodes.select("doc_id", F.posexplode("fps").alias("print", "fp"))
    each = cut(spark, single.groupBy("print", "fp").agg(F.min("doc_id").alias("doc_id")), "single-fingerprints") if prints > 1 else single
    found = links(spark, each)
    if prints > 1:  # different nodes may share one of their fingerprints
        same = single.join(each.withColumnRenamed("doc_id", "first"), ["print", "fp"]).where("doc_id <> first")
        found = found.unionByName(same.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    roots = components(spark, found).select(F.col("node").alias("doc_id"), "root")
    named = nodes.join(roots, "doc_id", "left").select("fps", F.coalesce("root", "doc_id").alias("component_id"))
    return fps.join(named, "fps").select("doc_id", "fps", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


# --- the pipeline's stage: five words, similarity of 0.8 ------------------------------------------------------------

WORDS = 5
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Equal minima from which a pair is a candidate: at a similarity of 0.8, 77 of 96 are expected, with a deviation of 4.
LEAST_EQUAL = 60
_XOR, _TIMES = (mixed(np.arange(HASHES, dtype=np.uint64), t)[:, None] | np.uint64(1) for t in (11, 12))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The different hashes of five words in a row (of all, if there are fewer), sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, size = xxhash.xxh64_intdigest, min(WORDS, len(words))
    each = np.array([digest(w) for w in words], np.uint64)
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mixed(h ^ each[k : k + n], 14)
    h.sort()
    return h[np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))]


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(BANDS keys, HASHES bytes) of a set: equal keys for equal minima of ROWS hashes, a byte of each minimum."""
    least = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(found), 4096):
        np.minimum(least, ((found[a : a + 4096] ^ _XOR) * _TIMES).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys ^ row, 13)
    return keys, (least >> np.uint64(32)).astype(np.uint8)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, same, bands, sketch): op8's fingerprint, a hash of the set, its keys and bytes. text_key is
    a hash of the text that the JVM can make again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                fps, same, bands, marks = [], [], [], []
                for t in plain_texts(batch.column(2)):
                    words = words_of(t.as_buffer().to_pybytes())
                    found = shingle_set(words)
                    keys, mark = sketch(found)
                    fps.append(int(fingerprint(words).view(np.int64)[0]))
                    same.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bands.append(keys.view(np.int64))
                    marks.append(mark.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "text_key", "fp", "same", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, text_key string, fp long, same binary, bands array<long>, sketch binary")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, sketch of a, sketch of b), the (a, b) with enough equal minima."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in (2, 3))
            keep = np.count_nonzero(one == two, axis=1) >= LEAST_EQUAL
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _joined(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links with a similarity of 0.8 or more that span the components which all such links make of one bucket's nodes,
    of which those with one root are joined already."""
    size = np.array([len(x) for x in sets])
    different, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    label, mark = root.copy(), np.zeros(len(different) + 1, bool)
    for i in range(len(node) - 1):
        other = np.flatnonzero((label[i + 1 :] != label[i]) & (5 * np.minimum(size[i + 1 :], size[i]) >= 4 * np.maximum(size[i + 1 :], size[i]))) + i + 1
        other = other[size[other] > 0]
        if not len(other) or not size[i]:
            continue
        own = flat[starts[i] : starts[i] + size[i]]
        mark[own] = True
        position, close = ragged(starts[other], size[other])
        both = np.add.reduceat(mark[flat[position]], np.concatenate([[0], close[:-1]]), dtype=np.int64)
        mark[own] = False
        for j in other[5 * both >= 4 * (size[other] + size[i] - both)].tolist():
            if label[j] != label[i]:
                yield int(min(node[i], node[j])), int(max(node[i], node[j]))
                label[label == label[j]] = label[i]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, part, node, root, set) sorted by (key, part): the links of :func:`_joined` in each run."""
    run: list[tuple] = []

    def linked() -> pa.RecordBatch:
        found = np.array(list(_joined(np.array([r[2] for r in run]), np.array([r[3] for r in run]), [r[4] for r in run])), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:4]), (np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(4)), strict=True):
            if run and row[:2] != run[-1][:2]:
                yield linked()
                run = []
            run.append((*row[:4], row[4].copy()))
    if run:
        yield linked()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            found = [shingle_set(words_of(t.as_buffer().to_pybytes())).tobytes() for t in plain_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "found"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, set of a, set of b), the (a, b) with a similarity of 0.8 or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = (np.frombuffer(s.as_buffer(), np.uint64) if s.as_buffer().size else np.zeros(0, np.uint64) for s in (x, y))
            both = len(np.intersect1d(one, two, assume_unique=True)) if 5 * min(len(one), len(two)) >= 4 * max(len(one), len(two)) else 0
            keep.append(5 * both >= 4 * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, the lower 32 bits of its set's hashes)."""
    for batch in batches:
        halves = [np.frombuffer(x.as_buffer(), np.uint32)[::2].tobytes() if x.as_buffer().size else b"" for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves, pa.binary())], names=["node", "half"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose ``sets`` (node, found) are similar."""
    both = pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b").select("a", "b", "one", "two")
    return both.mapInArrow(lean(_confirmed), "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(spark: SparkSession, docs: DataFrame, tile: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, same) and groups (same, first: the doc_id and text_key of the component's row that is kept)
    of the texts with a five-word similarity of 0.8 or more."""
    every = cut(spark, sketches(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "fp")).alias("first")
    distinct = every.groupBy("same").agg(first, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # a number for each different set, which the table keeps
    nodes = cut(spark, distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")

    # step one: each text of a bucket and the bucket's first, and op8's links
    keys = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("key", "pivot")
    members = cut(spark, keys.join(buckets, "key"), "bucket-members")
    marks = nodes.select("node", "sketch")
    stars = _ordered(members.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    stars = stars.join(marks.toDF("a", "one"), "a").join(marks.toDF("b", "two"), "b").select("a", "b", "one", "two").mapInArrow(lean(_alike), "a long, b long")
    prints = nodes.select(F.col("node").alias("doc_id"), F.lit(0).alias("print"), F.col("first.fp").alias("fp"))
    each = cut(spark, prints.groupBy("print", "fp").agg(F.min("doc_id").alias("doc_id")), "single-fingerprints")
    equal = prints.join(each.withColumnRenamed("doc_id", "other"), ["print", "fp"]).select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
    pairs = cut(spark, _ordered(stars.unionByName(links(spark, each)).unionByName(equal)), "candidates")
    # the sets of all texts that meet another one
    meet = members.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = nodes.join(meet, "node").select("node", F.col("first.doc_id").alias("__d"), F.col("first.text_key").alias("__k"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), text_key(F.col("text")).alias("__key"), "text")
    texts = texts.join(wanted, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k"))).select("node", "text")
    sets = cut(spark, texts.mapInArrow(lean(_sets), "node long, found binary").dropDuplicates(["node"]), "shingle-sets")
    one = cut(spark, confirmed(pairs, sets), "confirmed")
    roots = cut(spark, components(spark, one), "roots")
    # step two: texts of different components in one bucket; half of each hash is enough to find what is confirmed then
    placed = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    halves = sets.mapInArrow(lean(_halves), "node long, half binary")
    rows = _dealt(spark, placed.join(several, "key").join(halves, "node").select("key", "node", "root", "half"), "node", tile)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = rows.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(lean(_across), "a long, b long")
    pairs = cut(spark, _ordered(across), "candidates")
    if pairs.limit(1).count():
        roots = cut(spark, components(spark, one.unionByName(confirmed(pairs, sets))), "roots")
    named = nodes.join(roots, "node", "left").select("same", "first", F.coalesce("root", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min("first").alias("first"))
    return every.select("doc_id", "text_key", "same"), named.select("same", "root").join(kept, "root").select("same", "first")


def similar_texts(spark: SparkSession, docs: DataFrame, tile: int = 2048) -> DataFrame:
    """(doc_id, component_id): components of the texts with a five-word similarity of 0.8 or more."""
    rows, groups = grouped(spark, docs, tile)
    return rows.join(groups, "same").select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of :func:`similar_texts` stays, that with the smallest doc_id. Of rows equal
    in doc_id and text, the smallest in the other columns does."""
    rows, groups = grouped(spark, docs)
    fate = rows.groupBy("doc_id", "text_key").agg(F.first("same").alias("same"), F.count("*").alias("n")).join(groups, "same")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    fate = cut(spark, fate.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), stays.alias("__stays"), "n").where("not __stays or n > 1"), "fates")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("doc_id").cast("long").alias("__doc"), text_key(F.col("text")).alias("__key"))
    same = F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k"))
    out = keyed.join(fate, same, "left_anti").select("__row")
    if fate.where("__stays").limit(1).count():
        repeated = keyed.join(fate.where("__stays"), same).groupBy("__doc", "__key").agg(F.min("__row").alias("__row"))
        out = out.unionByName(repeated.select("__row"))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])
