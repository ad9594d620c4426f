"""Toxicity: a linear classifier over character n-grams, each feature scaled by its naive Bayes log-count ratio.

Texts are taken as UTF-8 bytes with A-Z lower-cased; n-grams of 3 to 6 bytes are hashed into 2^20 cells. A cell's
scale is the log of the ratio of its smoothed shares in toxic and other documents. A logistic regression over the
scaled presence features is fitted on a bounded sample of the labelled documents (``bound`` rows of each class).
Scoring is numpy over Arrow buffers, one pass, no shuffle.

Defined results: null and empty texts have no features and score sigmoid(bias), like any text without known
n-grams; labels other than 0 and 1 (or null) are not learned from; repeated label rows for a document count once, the
larger label wins; of several documents with a labelled doc_id one is learned from; without any label of one class the
score is 0.0 for all. Extra columns of the input are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import fit_sparse_logistic, sigmoid
from .shared import bounded_sample, crc_mod, lean, one_text_each, owners, release, table, text_chunks

BITS = 20
ORDERS = (3, 4, 5, 6)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def gram_cells(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (cell, text number) of every n-gram that lies within one text."""
    owner, low = owners(offsets), LOWER[data].astype(np.uint32)
    h = low.copy()
    for n in range(2, ORDERS[-1] + 1):
        if len(low) < n:
            return
        h = h[:-1] * np.uint32(16777619) + low[n - 1 :]
        if n in ORDERS:
            cell = ((h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            own = owner[: len(h)]
            inside = own == owner[n - 1 :]
            yield (cell, own) if inside.all() else (cell[inside], own[inside])


def presence(data: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell), sorted, of every cell that a text has, once whatever its n-grams' number or order; only cells
    that are ``used``, if that is given. The features of both the fit and the scores."""
    found = [np.zeros(0, np.int64)]
    for cell, own in gram_cells(data, offsets):
        if used is not None:
            hit = np.flatnonzero(used[cell])
            cell, own = cell[hit], own[hit]
        found.append(own.astype(np.int64) << BITS | cell)
    keys = np.sort(np.concatenate(found))
    keys = keys[np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))] if len(keys) else keys
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32 for each cell, with the ratio multiplied in; 0 for cells that aren't used
    bias: float
    trained: bool = True

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if not self.trained:
            return out
        used = self.weights != 0
        for a, b, data, offsets in text_chunks(column):
            own, cell = presence(data, offsets, used)
            out[a:b] = sigmoid(self.bias + np.bincount(own, weights=self.weights[cell], minlength=b - a))
        return out


def fit(texts: list[str | None], labels: np.ndarray, min_df: int = 4, min_ratio: float = 1.5, l2: float = 1e-3) -> ToxicityModel:
    """Fits on texts in the driver's memory; the caller bounds their number. Texts are gone through twice, so that their
    cells are never held whole."""
    y = np.asarray(labels, dtype=np.float64)
    width = 1 << BITS
    if not (0 < y.sum() < len(y)):
        return ToxicityModel(np.zeros(width, np.float32), 0.0, trained=False)
    column = pa.array(texts, pa.large_string())
    p, q = np.zeros(width), np.zeros(width)
    for a, _, data, offsets in text_chunks(column, 1 << 18):
        own, cell = presence(data, offsets)
        toxic = y[a + own] == 1
        p += np.bincount(cell[toxic], minlength=width)
        q += np.bincount(cell[~toxic], minlength=width)
    # shares of documents that have the cell
    ratio = np.log((p + 1) / (y.sum() + 2)) - np.log((q + 1) / ((1 - y).sum() + 2))
    used = (p + q >= min_df) & (np.abs(ratio) >= min_ratio)
    chosen = np.flatnonzero(used)
    number = np.zeros(width, np.int32)
    number[chosen] = np.arange(len(chosen))
    kept, count = [np.zeros(0, np.int32)], np.zeros(len(y), np.int64)
    for a, b, data, offsets in text_chunks(column, 1 << 18):
        own, cell = presence(data, offsets, used)
        kept.append(number[cell])
        count[a:b] = np.bincount(own, minlength=b - a)
    indices = np.concatenate(kept)
    indptr = np.concatenate([[0], np.cumsum(count)])
    w, bias = fit_sparse_logistic(indptr, indices, ratio[chosen].astype(np.float32)[indices], y, len(chosen), l2)
    weights = np.zeros(width, np.float32)
    weights[chosen] = w * ratio[chosen]
    return ToxicityModel(weights, bias)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: int) -> tuple[list, np.ndarray]:
    """The texts and labels of about ``bound`` documents of each class, without those held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out)
    rows = one_text_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bounded_sample(known, "doc_id", ["y"], bound)).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, remainder: int = 2, bound: int = 2500) -> ToxicityModel:
    texts, y = labelled_texts(docs, labels, "toxic", crc_mod("doc_id", mod) == remainder, bound)
    model = fit(texts, y)
    del texts
    release()
    return model


def score(docs: DataFrame, model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (doc_id by default) and the score, named ``name``. ``model`` has a method scores(Arrow column)."""
    keep = keep or ["doc_id"]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.scores(batch.column(len(keep))), pa.float64())], names=[*keep, name])

    return out.mapInArrow(lean(run), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.3 or more go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, docs.columns, "__toxicity").where("__toxicity < 0.3").drop("__toxicity")
