import collections
import hashlib
import re

import corpus_pipeline
from tidewire.llm.shared import cut, table


def run_stages(spark, at):
    docs, out = table(spark, at, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(spark, stage(spark, docs, at), "stage")
        out.append((name, docs))
    return out


def test_stages(spark, data):
    first = table(spark, data, "documents")
    stages = run_stages(spark, data)
    assert [n for n, _ in stages] == ["toxicity", "language", "near_duplicates", "mixing", "pieces"]
    before = {r["doc_id"]: r["text"] for r in first.collect()}
    for _, df in stages[:-1]:
        assert df.columns == first.columns
    for _, df in stages[:3]:  # filters: rows as they were, fewer and fewer
        now = {r["doc_id"]: r["text"] for r in df.collect()}
        assert now.items() <= before.items() and len(now) == df.count()
        before = now
    from tests.llm.test_contracts import plain_components, plain_fingerprint

    known = {r["doc_id"]: r["text"] for r in stages[1][1].collect()}
    groups = plain_components([(d, plain_fingerprint(t)) for d, t in known.items()])
    firsts = set(groups.values())
    assert set(before) <= firsts  # one of each group at most; further fingerprints may join groups
    assert len(before) >= 0.9 * len(firsts)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = collections.Counter()
    for r in stages[3][1].collect():
        assert before[r["doc_id"]].startswith(r["text"])
        mixed["words"] += size(r["text"])
    assert abs(mixed["words"] - 1.5 * sum(map(size, before.values()))) <= 20
    last = stages[4][1]
    assert last.count() == stages[3][1].count() and last.where("parity and round_trip").count() == last.count()
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "ids", "n_tokens", "parity", "round_trip"]


def test_awkward_and_empty(spark, tables, empty):
    assert [df.count() for _, df in run_stages(spark, empty)] == [0] * 5
    run_stages(spark, tables)[-1][1].collect()


def near_pairs(texts):
    """All pairs of five-word similarity 0.8 or more, plainly."""
    found = []
    for t in texts:
        w = (t or "").lower().split()
        found.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    same = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return {(i, j) for j in range(len(found)) for i in range(j) if same(found[i], found[j])}


def edited(r, words, n):
    """A copy with n single words changed, far enough apart to change five shingles each."""
    out = list(words)
    for i in r.choice(len(words) // 5, n, replace=False):
        out[5 * i + 2] += "x"
    return " ".join(out)


def test_near_copies_at_080(spark):
    """Copies with changed words, just at and above 0.8 and below it: what links is what the similarity says."""
    import numpy as np

    from tidewire.llm import simhash

    r, texts = np.random.default_rng(0), []
    for _ in range(60):
        words = [f"w{x}" for x in r.integers(0, 5000, 204)]
        texts += [" ".join(words), edited(r, words, int(r.choice([1, 2, 3, 4, 6, 8, 12])))]
    words = [f"h{x}" for x in r.integers(0, 5000, 204)]
    texts += [edited(r, words, int(n)) for n in r.integers(0, 4, 60)]  # one large group, dealt out when tile is small
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = list(range(len(texts)))
    for i, j in sorted(near_pairs(texts)):
        a, b = want[i], want[j]
        want = [min(a, b) if x in (a, b) else x for x in want]
    for tile in (2048, 16):
        got = {x["doc_id"]: x["component_id"] for x in simhash.similar_texts(spark, docs, tile=tile).collect()}
        assert [got[i] for i in range(len(texts))] == want
    kept = {x["doc_id"] for x in simhash.keep_one(spark, docs, "").collect()}
    assert kept == set(want)


def test_rows_that_stay_by_row_not_by_id(spark):
    """Each case has words of its own, so that one run covers all; ids clash across cases, which must not matter."""
    from tidewire.llm import simhash

    def row(doc_id, text, case, source="s"):
        text = text and " ".join(f"{w}{case}" for w in text.split())
        return doc_id, text, "en", source, len(text or "")

    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten eleven", "red green blue white black pink brown grey cyan gold")
    cases = [  # rows, and those that stay
        ([(3, a), (7, a), (7, b)], [(3, a), (7, b)]),
        ([(5, a), (5, a)], [(5, a)]),
        ([(None, a), (9, a), (None, b), (None, b)], [(9, a), (None, b)]),
        ([(4, a), (4, b), (4, c), (2, a.upper())], [(2, a.upper()), (4, b), (4, c)]),
        ([(None, a), (None, a.title())], [(None, min(a, a.title(), key=lambda t: hashlib.md5(" ".join(f"{w}4" for w in t.split()).encode()).hexdigest()))]),
    ]
    rows = [row(*r, k) for k, (given, _) in enumerate(cases) for r in given]
    want = [row(*r, k) for k, (_, stay) in enumerate(cases) for r in stay]
    rows += [row(5, a, "x", s) for s in "zam"] + [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " ", "en", "s", 1)]
    want += [row(5, a, "x", "a"), (1, None, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    out = simhash.keep_one(spark, spark.createDataFrame(rows, schema), "")
    assert out.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    assert simhash.keep_one(spark, spark.createDataFrame([], schema), "").count() == 0


def test_large_groups_by_exact_similarity(spark):
    """Families of hundreds whose pairs lie on both sides of 0.8: the result is that of all pairs."""
    import numpy as np

    from tidewire.llm import simhash

    r, texts = np.random.default_rng(5), []
    for spread in (3, 6, 9, 12):  # two members differ in up to twice as many words
        words = [f"f{spread}x{x}" for x in r.integers(0, 5000, 204)]
        texts += [edited(r, words, spread) for _ in range(90)]
    want = list(range(len(texts)))
    for i, j in sorted(near_pairs(texts)):
        a, b = sorted((want[i], want[j]))
        want = [a if x == b else x for x in want]
    assert 4 < len(set(want)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_texts(spark, docs, tile=32).collect()}
    assert [got[i] for i in range(len(texts))] == want
