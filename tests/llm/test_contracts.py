"""Each query over awkward and empty tables, and each against a plain version."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm.queries import ORACLES, QUERIES

NAMES = sorted(QUERIES)
COLUMNS = {
    "op1_pieces": "doc_id ids_crc32 n_tokens parity round_trip",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_extract": "page_id url text n_chars",
    "op5_quality": "doc_id held_out score predicted",
    "op6_maxscore": "query_id rank vec_id score",
    "op7_wavelet": "doc_id start n_tokens ids_crc32",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_forest": "query_id rank vec_id score",
    "op10_mixing": "doc_id size source_size target taken shards",
}


@pytest.mark.parametrize("name", NAMES)
def test_columns_and_empty_tables(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.columns == COLUMNS[name].split() and df.count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_and_reruns(spark, tables, name):
    one, two = (sorted(map(str, QUERIES[name](spark, tables).collect())) for _ in range(2))
    assert one == two and one


def documents(spark, at):
    return spark.read.parquet(f"{at}/documents.parquet").collect()


@pytest.fixture(params=["awkward", "data"])
def folder(request, tables, data):
    return tables if request.param == "awkward" else data


def test_pieces(spark, folder):
    judge = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for r in documents(spark, folder):
        ids = judge.encode(r["text"] or "")
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), "▁" not in (r["text"] or "")] += 1
    got = QUERIES["op1_pieces"](spark, folder).collect()
    assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["round_trip"]) for r in got)
    assert all(r["parity"] for r in got)


def test_tokens(spark, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, collections.Counter()
    for r in sorted((r for r in documents(spark, folder) if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert want == collections.Counter(tuple(r) for r in QUERIES["op7_wavelet"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect())


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """(doc_id, fp) to the smallest doc_id reachable."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    values = sorted({f for _, f in fps})
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for d, f in fps:
        least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least[find(f)] for d, f in fps}


def test_simhash(spark, folder):
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in documents(spark, folder) if r["doc_id"] is not None]
    want = plain_components(fps)
    got = QUERIES["op8_simhash"](spark, folder).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((d, f"{f:016x}", want[d, f]) for d, f in fps)


def test_simhash_links_and_hot_cells(spark):
    from tidewire.llm import simhash

    r = np.random.default_rng(0)
    base = [int(x) for x in r.integers(0, 1 << 62, 12)]
    values = {b ^ sum(1 << k for k in set(r.integers(0, 64, n).tolist())) for b in base for n in range(5) for _ in range(25)}
    rows = list(enumerate(sorted(values)))
    df = spark.createDataFrame([(i, int(np.array(f, np.uint64).view(np.int64))) for i, f in rows], "doc_id long, fp long").withColumn("print", F.lit(0))
    want = plain_components(rows)
    for tile in (4096, 8):
        roots = {x["node"]: x["root"] for x in simhash.components(spark, simhash.links(spark, df, tile=tile)).collect()}
        assert all(roots.get(d, d) == want[d, f] for d, f in rows)


def test_several_prints(spark, data):
    """Any of the fingerprints links; the first is the contract's."""
    from tidewire.llm import simhash

    docs = spark.read.parquet(f"{data}/documents.parquet")
    fps = {r["doc_id"]: [int(x) & (1 << 64) - 1 for x in r["fps"]] for r in simhash.fingerprints(docs, prints=3).collect()}
    for r in docs.collect():
        assert fps[r["doc_id"]][0] == plain_fingerprint(r["text"])
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and any((x ^ y).bit_count() <= 3 for x, y in zip(fps[a], fps[b], strict=True)):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, docs, prints=3).collect()}
    assert got == {d: find(d) for d in fps}


def test_embedding_bounds_hamming():
    from tidewire.llm import simhash

    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    counts = lambda x: np.array([[(int(v) >> 2 * k & 3).bit_count() for k in range(32)] for v in x])
    plain = np.abs(counts(a) - counts(b)).sum(1)
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) == plain).all()
    assert (plain <= np.bitwise_count(a ^ b)).all()


def vectors(spark, at, zero):
    out = []
    for r in spark.read.parquet(f"{at}/embeddings.parquet").collect():
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(x is None for x in v) or not np.isfinite(v).all() or not zero and not any(v):
            continue
        out.append((r["vec_id"], np.array(v, np.float64)))
    return out


def test_maxscore(spark, folder):
    rows = [(i, np.floor(256 * v).astype(np.int64)) for i, v in vectors(spark, folder, True)]
    want = set()
    for i, q in rows:
        if i % 50 == 0:
            scored = sorted((-int(q @ v), j) for j, v in rows if j != i and len(v) == len(q))[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)}
    assert want == {tuple(r) for r in QUERIES["op6_maxscore"](spark, folder).collect()}


def test_forest_recall(spark, folder):
    rows = vectors(spark, folder, False)
    got = collections.defaultdict(list)
    for r in QUERIES["op9_forest"](spark, folder).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    hits = total = 0
    for i, q in rows:
        if i % 100:
            continue
        near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in rows if j != i and len(v) == len(q))[:10]
        if not near:
            continue
        assert len(got[i]) == len(near) and got[i] == sorted(got[i])
        assert all(any(abs(s - float(np.sqrt(((v - q) ** 2).sum()))) < 1e-12 for k, v in rows if k == j and len(v) == len(q)) for s, j in got[i])
        hits += sum(s <= near[-1][0] + 1e-12 for s, _ in got[i])
        total += len(near)
    assert hits >= 0.9 * total


def test_mixing(spark, folder):
    got = QUERIES["op10_mixing"](spark, folder).collect()
    rows = documents(spark, folder)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r["doc_id"], size(r["text"])) for r in rows) == collections.Counter((r["doc_id"], r["size"]) for r in got)
    total = collections.Counter()
    for r in rows:
        total[r["source"]] += size(r["text"])
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    # share, cap, share the excess again, until none is above
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = 1.5 * sum(total.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] >= 2 * total[s]}
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        free -= full
    source = {r["doc_id"]: r["source"] for r in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_mixing_tree(spark):
    from tidewire.llm import mixing

    quotas = {0: 900, 1: 30, 2: 1, 3: 269}
    df = spark.createDataFrame(list(quotas.items()), "number int, quota long")
    rows = mixing.tree(spark, df, 7, seed=3).collect()
    per_source, per_shard = collections.Counter(), collections.Counter()
    for r in rows:
        per_source[r["number"]] += r["count"]
        per_shard[r["shard"]] += r["count"]
        assert r["count"] >= 0
    assert dict(per_source) == quotas and len(per_shard) == 7
    assert max(per_shard.values()) - min(per_shard.values()) <= 3  # 1200 over 7


def test_hypergeometric_draws(spark):
    from tidewire.llm import mixing

    draws = spark.range(4000).select(F.expr(f"transform(array(named_struct('pool', 60L, 'own', 25L, 'picks', 20L, 'u', (id + 0.5D) / 4000)), t -> {mixing._DRAW})[0]").alias("x")).collect()
    from math import comb

    seen = collections.Counter(r["x"] for r in draws)
    for x in range(21):
        p = comb(25, x) * comb(35, 20 - x) / comb(60, 20)
        assert abs(seen[x] / 4000 - p) < 1e-3


def test_mixed_rows(spark, tables):
    from tidewire.llm import mixing

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = mixing.mix(spark, docs).collect()
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in out)
    assert words == sum(r["taken"] for r in QUERIES["op10_mixing"](spark, tables).collect())
    assert all(whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in out)


def test_extract(spark, tables):
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in QUERIES["op4_extract"](spark, tables).collect()}
    assert {(1, "", 0), (2, "", 0), (3, "plain & simple", 14), (None, "x", 1)} <= got


def test_oracles_are_registered():
    assert set(ORACLES) <= set(QUERIES)


def test_mixing_of_many_sources(spark):
    """A hundred thousand sources, null and repeated ids, and a source with a third of all rows."""
    from tidewire.llm import mixing

    docs = spark.range(160_000).selectExpr(
        "if(id % 7 = 0, null, if(id % 5 = 0, 11, id)) as doc_id",
        "concat('w', id, ' x', if(id % 3 = 0, ' y z', '')) as text",
        "if(id >= 100000, 'hot', if(id = 5, null, concat('s', id))) as source",
    )
    sized = mixing.cut(spark, mixing.sizes(docs), "sizes")
    out = mixing.apply_plan(sized, mixing.plan(spark, sized, most_shards=8))
    taken = F.expr("aggregate(takes, 0L, (s, t) -> s + t.words)")
    bad = out.where((taken > 2 * F.col("size")) | (taken < 0)).count()
    sums = out.groupBy("src").agg(F.sum(taken).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n"))
    assert bad == 0 and sums.count() == 100_001 and sums.where("abs(taken - target) > 1").count() == 0
    shards = out.select(F.explode("takes").alias("t")).groupBy("t.shard").count().collect()
    assert len(shards) == 8


def test_tree_in_groups(spark):
    """Groups of sources: exact counts, level shards, and a source's share of a shard as in the plain distribution."""
    from tidewire.llm import mixing

    quotas = {k: 40 if k == 3 else 1 + k % 4 for k in range(30)}
    df = spark.createDataFrame(list(quotas.items()), "number int, quota long")
    total, seen = sum(quotas.values()), []
    for seed in range(12):
        rows = mixing.tree(spark, df, 4, seed=seed, group_sources=4 if seed % 2 else 1024).collect()
        per_source, per_shard = collections.Counter(), collections.Counter()
        for r in rows:
            assert r["count"] > 0
            per_source[r["number"]] += r["count"]
            per_shard[r["shard"]] += r["count"]
            if r["number"] == 3:
                seen.append(r["count"])
        assert dict(per_source) == quotas and max(per_shard.values()) - min(per_shard.values()) <= 2
    # 48 draws of a mean of 10 and a variance of about 10 * (1 - 40 / total) * 0.75
    assert len(seen) >= 47 and abs(sum(seen) / 48 - 10) < 1e-9 and 2 < np.var(seen) < 13 and total > 80
