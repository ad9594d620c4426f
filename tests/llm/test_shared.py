import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tidewire.llm import cuts, shared


def test_shared_folder(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(applicationId="app"))
    assert shared.shared_dir(unset).startswith("file:///") and shared.shared_dir(unset) == shared.shared_dir(unset)


def test_cut_and_drop(spark):
    df = shared.cut(spark, spark.range(5), "x")
    at = df._tidewire_path.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(at.replace("//", "/"))
    shared.drop_cut(spark, df)
    assert not os.path.isdir(at.replace("//", "/"))
    shared.drop_cut(spark, spark.range(1))


def test_text_chunks():
    texts = ["a" * 10, None, "", "b" * 100, "é"]
    column = pa.array(["skipped", *texts]).slice(1)
    for most in (1, 15, 1000):
        got = []
        for a, b, data, offsets in shared.text_chunks(column, most):
            assert b > a and len(offsets) == b - a + 1
            got += [data[s:e].tobytes().decode() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [t or "" for t in texts]


def test_bounded_sample(spark):
    rows = spark.range(4000).selectExpr("id", "cast(id % 2 as int) as y")
    assert shared.bounded_sample(rows, "id", ["y"], 10_000).count() == 4000
    some = shared.bounded_sample(rows, "id", ["y"], 200)
    assert 300 < some.count() < 500 and sorted(some.collect()) == sorted(shared.bounded_sample(rows, "id", ["y"], 200).collect())


def test_cut_table_begins_anew():
    def learn(new):
        return [np.array([len(c), c[0]], np.uint16) for c in new], [c[0] == 98 for c in new]

    table = cuts.CutTable(learn, np.uint16, most=2)
    for words in (["a", "bb", "a"], ["ccc", "a", "bb"], ["d", "bb"]):
        data = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        ids, close, odd = table.encode(data, ends - [len(w) for w in words], ends)
        assert ids.tolist() == [x for w in words for x in (len(w), ord(w[0]))]
        assert close.tolist() == [2 * (k + 1) for k in range(len(words))] and odd.tolist() == [w[0] == "b" for w in words]
