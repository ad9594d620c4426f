"""Exact top-k inner-product search by MaxScore over inverted postings.

Vectors become integers, floor(256 x). In a shard, dimension d has two terms: (d, +) scores x_d - min_d and (d, -)
scores max_d - x_d, both 0 or more, so that for a query every term adds |q_d| times a weight of 0 or more, and the
inner product is that sum plus a constant of the query and shard. A term's postings are the rows with a weight above
0, and its bound is |q_d| times the largest weight.

A query's terms in order of bound: the non-essential terms are those whose bounds add up to no more than what separates
the threshold (the k-th best score known so far) from a row without any other term. The postings of the essential
terms are traversed; the rows that they reach are then probed in the non-essential terms, strongest first, as long as
score so far plus the bounds of the terms left is competitive. The threshold starts from the rows that score best on
the strongest terms, and shards are merged by score.

Exact: a row is given up only when its bound is under the threshold (rows that tie with it stay). Sums of rows and
queries whose integers stay below a bound that depends on the width can't leave 64 bits; larger ones ("wide") are summed in
Python's integers instead.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of another length
than the query's are no candidates for it, and vectors without components score 0 with each other; repeated vec_ids
are rows of their own, but a query's own vec_id is never its candidate; a score beyond a long's range counts as its
largest or smallest value, so that such scores tie. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .vectors import search, usable


LEAST_SCORE, MOST_SCORE = -(1 << 63), (1 << 63) - 1


def limit(width: int) -> int:
    """Integers up to this can be multiplied and added over ``width`` components, ranges included, within 62 bits."""
    return math.isqrt((1 << 60) // max(1, width))


def whole(vector: np.ndarray) -> list[int]:
    """floor(256 x) of each component, exactly, whatever its size."""
    return [256 * n // d for n, d in (x.as_integer_ratio() for x in vector.tolist())]


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floor(256 x), which rows are wide); a wide row's integers aren't to be used."""
    with np.errstate(over="ignore"):
        f = np.floor(256 * x)
    wide = (np.abs(f) > limit(x.shape[1])).any(1)
    return np.where(wide[:, None], 0, f).astype(np.int64), wide


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """A shard's index: postings of each term as (rows, weights), and its largest weight; wide rows apart."""
    xi, wide = rounded(x)
    out = {"wide": [(int(i), whole(v)) for i, v in zip(ids[wide], x[wide], strict=True)]}
    ids, xi = ids[~wide], xi[~wide]
    if not len(ids):
        return out | {"ids": ids, "rows": xi}
    low, high = xi.min(0), xi.max(0)
    up, down = np.ascontiguousarray((xi - low).T), np.ascontiguousarray((high - xi).T)
    lists = []
    for w in (up, down):
        rows = [np.flatnonzero(c) for c in w]
        lists.append([(r, c[r]) if len(r) < len(c) else (None, c) for r, c in zip(rows, w, strict=True)])
    return out | {"ids": ids, "low": low, "high": high, "weights": (up, down), "postings": lists, "most": (up.max(1), down.max(1)), "rows": xi}


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest scores, ties to smaller ids."""
    if len(scores) > k:
        stay = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[stay], scores[stay]
    order = np.lexsort((ids, ~scores))[:k]
    return ids[order], scores[order]


def top(index: dict, qids: np.ndarray, q: np.ndarray, k: int, floors: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (row, ids, scores) of its best k, ties to smaller ids; those below the query's floor may be left
    out."""
    asked, wide = rounded(q)
    for row, query in enumerate(asked):
        own = int(qids[row])
        apart = index["wide"]
        if wide[row]:
            apart = apart + [(i, v) for i, v in zip(index["ids"].tolist(), index["rows"].tolist(), strict=True)]
        elif len(index["ids"]):
            yield row, *narrow(index, own, query, k, floors[row])
        if apart:
            exact = whole(q[row])
            scored = [(i, min(max(sum(a * b for a, b in zip(v, exact, strict=True)), LEAST_SCORE), MOST_SCORE)) for i, v in apart if i != own]
            yield row, *best_of(*(np.array(c, np.int64) for c in (zip(*scored, strict=True) if scored else ([], []))), k)


def narrow(index: dict, own_id: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
    """MaxScore over a shard's postings: (ids, scores) of the best k that aren't below ``floor``."""
    ids, n = index["ids"], len(index["ids"])
    sign = (query < 0).astype(int)
    size = np.abs(query)
    base = int((query * np.where(sign == 0, index["low"], index["high"])).sum())
    bounds = size * np.where(sign == 0, index["most"][0], index["most"][1])
    terms = np.argsort(-bounds, kind="stable")
    terms = terms[bounds[terms] > 0]
    left = np.concatenate([np.cumsum(bounds[terms][::-1])[::-1], [0]])  # what terms from t on can still add
    floor = -1 if floor is None else floor - base
    if floor > left[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = ids == own_id
    score = np.zeros(n, np.int64)

    def add(t: int) -> None:
        rows, weight = index["postings"][sign[t]][t]
        if rows is None:
            np.add(score, size[t] * weight, out=score)
        else:
            score[rows] += size[t] * weight

    # a first threshold: full scores of the rows that the strongest terms favour
    start = min(8, len(terms))
    for t in terms[:start]:
        add(t)
    score[own] = -1
    lead = np.argpartition(-score, min(4 * k, n - 1))[: 4 * k] if n > 4 * k else np.arange(n)
    lead = lead[~own[lead]]
    full = index["rows"][lead] @ query - base
    threshold = max(floor, int(np.partition(full, len(full) - k)[len(full) - k]) if len(full) >= k else -1)
    # essential terms: without any of them a row can't reach the threshold
    essential = int(np.searchsorted(-left, -threshold, side="right")) if threshold >= 0 else len(terms)
    essential, place = max(start, min(essential, len(terms))), start
    while place < essential:
        if threshold >= 0 and place % 4 == 0 and np.count_nonzero(score + left[place] >= threshold) * 4 < n:
            essential = place  # few rows are competitive: the other terms are probed for them alone
            break
        add(terms[place])
        score[own] = -1
        place += 1
    alive = np.flatnonzero((score + left[essential] >= threshold) & ~own) if threshold >= 0 else np.flatnonzero(~own)
    part = score[alive]
    for place in range(essential, len(terms)):
        t = terms[place]
        part = part + size[t] * index["weights"][sign[t]][t][alive]
        if place % 4 == 3 or len(alive) > 4096:
            if len(part) >= k:
                threshold = max(threshold, int(np.partition(part, len(part) - k)[len(part) - k]))
            stay = part + left[place + 1] >= threshold
            alive, part = alive[stay], part[stay]
    return best_of(ids[alive], part + base, k)


def exact_top_k(spark: SparkSession, embeddings: DataFrame, every: int = 50, k: int = 5, shard_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``."""
    return search(spark, usable(embeddings), embeddings.count(), every, k, build, top, "long", True, shard_rows, block_rows)


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark, table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v, len(embedding) AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND q.n = c.n WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
