"""Quality: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

A text's tokens are its runs of letters, digits and non-ASCII bytes (A-Z lower-cased) and its runs of one repeated
symbol; a token equal to the one before it counts as a repeat marker, so that stuttering text shares features.
Unigrams and bigrams of tokens are hashed into 2^20 cells; a text is the sparse vector of the square roots of their
shares, which has length 1, and its score the logistic function of a sparse dot product with the weights.

The fit (FTRL-proximal, one update for each document, L1 and L2 penalties) takes a bounded sample of the labelled
documents (``bound`` rows of each class). Scoring is numpy over Arrow buffers, one pass, no shuffle.

Defined results: null and empty texts and texts of white space have no features and score sigmoid(bias); labels other
than 0 and 1 are not learned from; of repeated label rows the larger label counts; with one class only, its label is
the score of every text, and without labels 0.0 is. Extra columns of the input are kept out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import sigmoid
from .shared import crc_mod, owners, release, table, text_chunks
from .toxicity import LOWER, labelled_texts, score

BITS = 20
#: Class of each byte: 0 white space, 1 part of a word, else the symbol itself.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[[32, 9, 10, 11, 12, 13, 0]] = 0
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
REPEAT = np.uint64(0x1F3D5B79A8C6E402)
BASE = 0x5851F42D4C957F2D


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_tables: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; those of a long text are not kept."""
    kept = 1 << 20
    if n > kept + 1:
        return powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
    if not _tables:
        _tables[:] = [powers(BASE, kept + 1), powers(pow(BASE, -1, 1 << 64), kept + 1)]
    return _tables[0], _tables[1]


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every token in order."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    owner, kind = owners(offsets), CLASS[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[1:] |= owner[1:] != owner[:-1]
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(data))
    real = kind[at] != 0
    at, ends = at[real], ends[real]
    up, down = power_tables(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LOWER[data].astype(np.uint64) * up[: len(data)], dtype=np.uint64)])
    h = (total[ends] - total[at]) * down[at]
    own = owner[at]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    h[again] = REPEAT
    return h, own


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, cell, value), sorted by text and cell."""
    h, own = token_hashes(data, offsets)
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    same = own[1:] == own[:-1]
    two = ((h[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ h[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS))[same]
    keys = np.concatenate([own.astype(np.int64) << BITS | one.astype(np.int64), own[1:][same].astype(np.int64) << BITS | two.astype(np.int64)])
    keys, count = np.unique(keys, return_counts=True)
    row = keys >> BITS
    total = np.bincount(row, weights=count, minlength=len(offsets) - 1)
    return row, keys & ((1 << BITS) - 1), np.sqrt(count / total[row])


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    fixed: float | None = None

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.fixed if self.fixed is not None else 0.0)
        if self.fixed is not None:
            return out
        for a, b, data, offsets in text_chunks(column):
            row, cell, value = features(data, offsets)
            out[a:b] = sigmoid(np.bincount(row, weights=value * self.weights[cell], minlength=b - a) + self.bias)
        return out


def fit(texts: list[str | None], labels: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0, epochs: int = 3, seed: int = 11) -> QualityModel:
    """FTRL-proximal on texts in the driver's memory; the caller bounds their number."""
    y = np.asarray(labels, dtype=np.float64)
    width = 1 << BITS
    if not (0 < y.sum() < len(y)):
        return QualityModel(np.zeros(width, np.float32), 0.0, fixed=float(y[0]) if len(y) else 0.0)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b, data, offsets in text_chunks(pa.array(texts, pa.large_string())):
        row, cell, value = features(data, offsets)
        ends = np.searchsorted(row, np.arange(b - a + 1))
        docs += [(np.append(cell[s:e], width), np.append(value[s:e], 1.0)) for s, e in zip(ends[:-1], ends[1:], strict=True)]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    z, n = np.zeros(width + 1), np.zeros(width + 1)

    def current(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(docs)):
            i, x = docs[k]
            w = current(i)
            g = (sigmoid(x @ w) - y[k]) * weight[k] * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = current(np.arange(width + 1))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, remainder: int = 0, bound: int = 2500) -> QualityModel:
    texts, y = labelled_texts(docs, labels, "quality", crc_mod("doc_id", mod) == remainder, bound)
    model = fit(texts, y)
    del texts
    release()
    return model


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
