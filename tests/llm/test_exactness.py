"""Cases that a plain version must agree on: long and colliding words, samples of huge tables, wide integers, recall."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import cuts, forest, language, maxscore, pieces, quality, shared, toxicity, wavelet


def thue_morse(n):
    """Two different words of n letters that any polynomial hash modulo 2^64 takes for one."""
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join("ab"[x] for x in s[:n]), "".join("ba"[x] for x in s[:n])


LONG = [t for n in (1024, 4096, 65536) for a, b in [thue_morse(n)] for t in (a, b, f"{a} {b}", f"x {b} {a}, {a}")]


def test_words_that_collide_in_polynomial_hashes():
    import sentencepiece
    from tokenizers import Tokenizer

    with open(pieces.default_model(), "rb") as f:
        data = f.read()
    codec, judge = pieces.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for verified in (codec, pieces.Codec(data, verify=False)):
        ids, parity = verified.encode(pa.array(LONG))
        assert [i.tolist() for i in ids] == judge.encode(LONG) and all(parity)
        assert [b.decode() for b in verified.decode(ids)] == LONG
    with open(wavelet.default_tokenizer(), encoding="utf-8") as f:
        text = f.read()
    encoder, judge = wavelet.Encoder(text), Tokenizer.from_str(text)
    assert [i.tolist() for i in encoder.encode(pa.array(LONG))] == [e.ids for e in judge.encode_batch(LONG, add_special_tokens=False)]


def test_parity_is_false_where_the_libraries_differ():
    with open(pieces.default_model(), "rb") as f:
        codec = pieces.Codec(f.read())
    texts = ["some words here", "other  words"]
    first, _ = codec.encode(pa.array(texts))

    class Judge:  # takes every text for one unknown piece
        def encode(self, x, num_threads=1):
            return [0] if isinstance(x, str) else [[0] for _ in x]

    codec.judge, codec.table = Judge(), cuts.CutTable(codec._learn, np.uint32)
    ids, parity = codec.encode(pa.array(texts))
    assert parity == [False, False] and [i.tolist() for i in ids] == [i.tolist() for i in first]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=40), max_size=12), max_size=4))
def test_cut_table_by_bytes(batches):
    """Every cut gets its own bytes back, whatever its hash; all hashes alike at worst."""
    for places in (cuts.places, lambda words: np.zeros(len(words), np.uint64)):
        before, cuts.places = cuts.places, places
        try:
            table = cuts.CutTable(lambda new: ([np.frombuffer(c, np.uint8) for c in new], [c[0] % 2 == 1 for c in new]), np.uint8, most=3)
            for words in batches:
                data = np.frombuffer(b"".join(words), np.uint8)
                ends = np.cumsum([len(w) for w in words], dtype=np.int64)
                ids, close, odd = table.encode(data, ends - [len(w) for w in words], ends)
                assert ids.tobytes() == data.tobytes() and (close == ends).all() and odd.tolist() == [w[0] % 2 == 1 for w in words]
        finally:
            cuts.places = before


# --- samples -------------------------------------------------------------------------------------------------------


def test_thresholds_of_huge_counts():
    for bound in (800, 2500):
        for count in (1, bound, bound + 1, 10**6, 839_000_000, 10**10, 10**15):
            kept = count * shared.sample_threshold(bound, count) / 2**shared.HASH_BITS
            assert kept == pytest.approx(min(bound, count), rel=1e-6)


def test_sample_of_many_classes(spark):
    rows = spark.range(1_000_000).selectExpr("id", "if(id % 3 = 0, 'en', concat('x', id)) as lang").unionByName(spark.createDataFrame([(-1, None)], "id long, lang string"))
    some = shared.bounded_sample(rows, "id", ["lang"], 100, most_classes=5).groupBy("lang").count().collect()
    found = {r["lang"]: r["count"] for r in some}
    assert 60 < found.pop("en") < 150 and found == {"x1": 1, "x10": 1, "x100": 1, "x1000": 1} and len(found) == 4


def test_sample_with_repeated_ids(spark):
    docs = spark.range(3000).selectExpr("cast(if(id < 1000, 7, id) as long) as doc_id", "concat('text ', id) as text", "'en' as lang")
    one = shared.one_text_each(docs, docs.select("doc_id").distinct())
    assert one.count() == 2001 and one.where("doc_id = 7").count() == 1
    assert language.train(docs, bound=50).families == ["germanic"]


def test_scores_by_single_n_grams():
    """op2: a text's score is the sum over its different cells; op5: the dot product of its cells' shares; both by loops."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(3, 60))) + " BAD" * (k % 2) for k in range(200)] + ["", "a", "ab"]
    labels = np.array([k % 2 for k in range(200)] + [0, 0, 1])
    model = toxicity.fit(texts, labels)
    model.weights = np.random.default_rng(0).normal(size=1 << toxicity.BITS).astype(np.float32)  # every cell counts
    got = model.scores(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        raw, cells = text.encode().lower(), set()
        for n in toxicity.ORDERS:
            for i in range(len(raw) - n + 1):
                h = 0
                for k, c in enumerate(raw[i : i + n]):
                    h = c if k == 0 else (h * 16777619 + c) & 0xFFFFFFFF
                cells.add(((h ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 2654435761 & 0xFFFFFFFF) >> (32 - toxicity.BITS))
        z = model.bias + sum(float(model.weights[c]) for c in cells)
        assert score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, z)))), abs=1e-9)
    model = quality.fit(texts, labels)
    model.weights = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32)
    got = model.scores(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        row, cell, value = quality.features(data, np.array([0, len(data)]))
        assert len(cell) == 0 or sum(v * v for v in value.tolist()) == pytest.approx(1)
        z = model.bias + sum(float(model.weights[c]) * v for c, v in zip(cell.tolist(), value.tolist(), strict=True))
        assert score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, z)))), abs=1e-6)


def test_a_fit_counts_what_a_score_adds():
    """With all cells in use, presence() without and with a mask are one."""
    data = np.frombuffer(b"abcabcabcabd" * 50, np.uint8)
    offsets = np.array([0, 100, 100, 400, 600])
    for a, b in zip(toxicity.presence(data, offsets), toxicity.presence(data, offsets, np.ones(1 << toxicity.BITS, bool)), strict=True):
        assert (a == b).all()


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_language", "op5_quality"])
def test_held_out_labels_are_not_learned(spark, data, tmp_path, name):
    """Turning every held-out label round, or dropping it, leaves all scores as they were."""
    from tidewire.llm.queries import QUERIES

    mod, rest = (5, 0) if name == "op5_quality" else (4, 2)
    held = shared.crc_mod("doc_id", mod) == rest
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    turned = [F.when(held, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")]
    labels.select("doc_id", *turned).write.parquet(f"{tmp_path}/labels.parquet")
    one, two = (sorted(map(tuple, QUERIES[name](spark, at).collect())) for at in (data, str(tmp_path)))
    assert one == two


# --- vectors -------------------------------------------------------------------------------------------------------


def brute(rows, every, k, score):
    out = set()
    for i, q in rows:
        if i % every == 0:
            scored = sorted((score(q, v), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out |= {(i, n + 1, j, abs(s) if score is distance else -s) for n, (s, j) in enumerate(scored)}
    return out


def distance(a, b):
    return float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))


def inner(a, b):
    whole = lambda v: [256 * n // d for n, d in (float(x).as_integer_ratio() for x in v)]
    return -max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(whole(a), whole(b), strict=True))))


@pytest.mark.parametrize("shard_rows", [7, 4096])
def test_wide_and_empty_vectors(spark, shard_rows):
    """Integers beyond 64 bits, sums beyond 64 bits of narrow ones, vectors without components, several widths."""
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=3)]) for i in range(40)]
    rows += [(50, [1e18, 0.0, 0.0]), (51, [1e18, 0.5, 0.0]), (52, [-1e18, 0.0, 0.0]), (53, [1.0, 0.0, 0.0]), (100, [1e300, 1.0, -1e300])]
    rows += [(200 + i, [3e6] * 64) for i in range(2)] + [(202, [3e6] * 63 + [3e6 + 1])]
    rows += [(300 + i, []) for i in range(8)] + [(400 + i, [0.25 * i]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(x) for x in maxscore.exact_top_k(spark, df, every=50, k=5, shard_rows=shard_rows, block_rows=2).collect()}
    assert got == brute(rows, 50, 5, inner)
    assert forest.neighbours(spark, df.where("vec_id between 300 and 399"), every=100).count() == 0


def test_maxscore_on_whole_numbers(spark):
    """Many ties, over many shards, with thresholds handed on."""
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for shard_rows, block_rows in ((50, 3), (4096, 1024)):
        got = {tuple(x) for x in maxscore.exact_top_k(spark, df, shard_rows=shard_rows, block_rows=block_rows).collect()}
        assert got == brute(rows, 50, 5, inner)


@pytest.mark.parametrize("kind", ["noise", "clusters", "few"])
def test_recall_of_the_forest(spark, tmp_path, kind):
    """Against brute force: 20,000 vectors of noise or in clusters, and a table of one leaf or two."""
    r = np.random.default_rng(2)
    n = 150 if kind == "few" else 20_000
    x = r.normal(size=(n, 48))
    if kind == "clusters":
        x = 0.3 * x + r.normal(size=(60, 48))[r.integers(0, 60, n)]
    path = f"{tmp_path}/x.parquet"
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float64()))}), path)
    got = {}
    for row in forest.neighbours(spark, spark.read.parquet(path), every=100).collect():
        got.setdefault(row["query_id"], {})[row["vec_id"]] = row["score"]
    hits = total = 0
    for i in range(0, n, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        near = np.lexsort((np.arange(n), d))[:10]
        assert len(got[i]) == 10 and all(s == pytest.approx(d[j], rel=1e-12) for j, s in got[i].items())
        hits += len(set(near.tolist()) & set(got[i]))
        total += 10
    assert hits >= 0.9 * total


def test_the_forest_leaves_rows_out():
    """The rule really prunes, and prunes more where vectors cluster."""
    r, seen = np.random.default_rng(3), {}

    class Counted:
        def __init__(self, x):
            self.x, self.n = x, 0

        def __getitem__(self, rows):
            self.n += len(rows)
            return self.x[rows]

    for kind in ("noise", "clusters"):
        x = r.normal(size=(8000, 48)) if kind == "noise" else 0.3 * r.normal(size=(8000, 48)) + r.normal(size=(60, 48))[r.integers(0, 60, 8000)]
        index = forest.build(np.arange(8000), x)
        index["x"] = Counted(x)
        list(forest.nearest(index, np.arange(0, 8000, 400), x[::400], 10, [None] * 20))
        seen[kind] = index["x"].n / 20 / 8000
    assert seen["noise"] < 0.85 and seen["clusters"] < 0.3


def test_equal_roots_tie():
    """Two squares that differ but have one root: the smaller id comes first."""
    a = 1.0
    while math.sqrt(a) != math.sqrt(np.nextafter(a, 2)):
        a = np.nextafter(a, 2)
    low = math.sqrt(0.5)
    pair = [(x, y) for x in (low, np.nextafter(low, 1), np.nextafter(low, 0)) for y in (low, np.nextafter(low, 1), np.nextafter(low, 0))]
    x = np.array([[0.0, 0.0]] + [list(p) for p in pair])
    ids = np.array([99, *range(len(pair) - 1, -1, -1)])
    index = forest.build(ids, x)
    ((_, got, d),) = forest.nearest(index, np.array([99]), x[:1], 3, [None])
    far = np.sqrt((x[1:] ** 2).sum(1))
    want = np.lexsort((ids[1:], far))[:3]
    assert got.tolist() == ids[1:][want].tolist() and d.tolist() == far[want].tolist()
