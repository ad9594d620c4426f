"""Approximate nearest neighbours: a forest of random-projection trees in each shard, searched through one shared
priority queue, then exact reranking of the leaves' candidates.

A tree splits a shard's rows at the median of their projections on a random direction, down to leaves of ``LEAF``
rows; every row is in one leaf of every tree. A query walks all trees through one queue, keyed by the largest distance
to a plane that was crossed on the way. A neighbour at distance d lies across planes that are about d / sqrt(width) away
at most, as that is a random direction's share of d; so a query ends when the nearest plane left is farther than
``SLACK`` times that share of the k-th best distance so far, in this shard or one before it. The distances of the leaves' rows are computed in
double precision on the original vectors.

The rule is the same at every size. How much of a shard it visits depends on the vectors: a sixth where they cluster,
two thirds or more where they are noise and all distances are alike.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates for it; repeated vec_ids are rows of their own, but a query's own vec_id is
never its candidate; equal vectors tie, and smaller ids come first; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .vectors import search, usable

LEAF, TREES, SLACK = 64, 12, 0.5


def build(ids: np.ndarray, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> dict:
    """Nodes of all trees in one list: (direction's number, threshold, left, right), or a leaf's rows."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple | np.ndarray] = []
    directions: list[np.ndarray] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(rows)
        if len(rows) <= leaf:
            return at
        d = rng.standard_normal(x.shape[1])
        p = x[rows] @ (d / np.linalg.norm(d))
        order = np.argsort(p, kind="stable")
        half = len(rows) // 2
        if p[order[0]] == p[order[-1]]:  # equal vectors: by row, so that leaves stay small
            order = np.arange(len(rows))
        number = len(directions)
        directions.append(d / np.linalg.norm(d))
        left, right = rows[order[:half]], rows[order[half:]]
        threshold = (p[order[half - 1]] + p[order[half]]) / 2
        nodes[at] = (number, threshold, grow(left, depth + 1), grow(right, depth + 1))
        return at

    roots = [grow(np.arange(len(ids)), 0) for _ in range(trees if len(ids) > leaf else 1)]
    return {"ids": ids, "x": x, "nodes": nodes, "roots": roots, "directions": np.array(directions).reshape(-1, x.shape[1])}


def nearest(index: dict, qids: np.ndarray, q: np.ndarray, k: int, floors: list, slack: float = SLACK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (row, ids, distances) of the nearest found."""
    ids, x, nodes = index["ids"], index["x"], index["nodes"]
    projected = q @ index["directions"].T if len(index["directions"]) else np.zeros((len(q), 0))
    typical = slack / np.sqrt(max(1, q.shape[1]))  # a random direction's share of a distance, times the slack
    for row in range(len(q)):
        p = projected[row].tolist()
        queue = [(-np.inf, root) for root in index["roots"]]  # (margin, node)
        heapq.heapify(queue)
        new = np.ones(len(ids), bool)
        new[ids == qids[row]] = False
        leaves: list[np.ndarray] = []
        rows, d = np.zeros(0, np.int64), np.zeros(0)
        reached = np.inf if floors[row] is None else floors[row]
        held, check = 0, 2 * LEAF

        def rerank() -> None:
            nonlocal rows, d, reached
            more = np.concatenate(leaves)
            far = x[more] - q[row]
            # different squares may have one root, and then tie
            rows, d = np.concatenate([rows, more]), np.concatenate([d, np.sqrt(np.einsum("ij,ij->i", far, far))])
            leaves.clear()
            if len(rows) > k:
                last = np.partition(d, k - 1)[k - 1]
                rows, d = rows[d <= last], d[d <= last]
            if len(rows) >= k:
                reached = min(reached, float(d.max()))

        while queue and queue[0][0] <= reached * typical:
            margin, at = heapq.heappop(queue)
            node = nodes[at]
            while type(node) is tuple:
                number, threshold, left, right = node
                gap = p[number] - threshold
                near, far = (left, right) if gap < 0 else (right, left)
                heapq.heappush(queue, (max(margin, abs(gap)), far))
                node = nodes[near]
            fresh = node[new[node]]
            if len(fresh):
                new[fresh] = False
                leaves.append(fresh)
                held += len(fresh)
                if held >= check:
                    rerank()
                    check = 2 * held
        if leaves:
            rerank()
        order = np.lexsort((ids[rows], d))[:k]
        yield row, ids[rows[order]], d[order]


def neighbours(spark: SparkSession, embeddings: DataFrame, every: int = 100, k: int = 10, shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``; score is the Euclidean
    distance."""
    return search(spark, usable(embeddings, allow_zero=False), embeddings.count(), every, k, build, nearest, "double", False, shard_rows, block_rows)


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, table(spark, sf_dir, "embeddings"))
