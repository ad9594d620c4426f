import math

import numpy as np
import pytest

from tidewire.functions.text import clean_text
from tidewire.operators import clusters, similarity, topics
from tidewire.operators.vectorize import Tfidf
from tidewire.plans.pipeline import Analyzer, Config, analyze
from tidewire.plans.service import NoData, Service
from tidewire.schema import ANALYZED, articles_from_documents


@pytest.fixture(scope="module")
def model(spark, data):
    docs = articles_from_documents(spark.read.parquet(f"{data}/documents.parquet")).select("doc_idx", clean_text("contenido").alias("contenido_limpio"))
    return Tfidf(docs.persist())


def test_weights_have_length_one(model):
    rows = model.weights().groupBy("doc_idx").agg({"weight": "count"}).count()
    norms = model.weights().selectExpr("doc_idx", "weight * weight as w").groupBy("doc_idx").sum("w").collect()
    assert rows == len(norms) and all(abs(r[1] - 1) < 1e-9 for r in norms)


def test_vectors_equal_tidy_weights(model):
    vectors, words = model.vectors()
    tidy = {(r["doc_idx"], r["term"]): r["weight"] for r in model.weights().collect()}
    for r in vectors.limit(20).collect():
        for i, w in zip(r["features"].indices, r["features"].values, strict=True):
            assert math.isclose(tidy[r["doc_idx"], words[i]], w, rel_tol=1e-9)


def test_neighbours(model):
    join = {r["doc_idx"]: (r["most_similar_doc_idx"], r["max_similarity"]) for r in similarity.nearest_by_join(model.weights(), model.docs).collect()}
    blocks = {r["doc_idx"]: (r["most_similar_doc_idx"], r["max_similarity"]) for r in similarity.nearest_by_blocks(model.weights(), model.vocab, model.docs, rows=40).collect()}
    assert join.keys() == blocks.keys() and len(join) == 200
    for d, (other, sim) in join.items():
        assert other != d and -1e-9 <= sim <= 1 + 1e-9
        assert blocks[d][0] == other and abs(blocks[d][1] - sim) < 1e-9


def test_topics_and_clusters(model):
    vectors, words = model.vectors()
    vectors = vectors.persist()
    found = topics.fit(vectors, words, num_topics=3, passes=2)
    rows = found.assigned.collect()
    assert len(rows) == 200 and all(0 <= r["topic_id"] < 3 and 1 / 3 - 1e-9 <= r["topic_probability"] <= 1 for r in rows)
    assert found.catalogue.count() == 3 and found.perplexity > 0
    one, two = (clusters.fit(vectors, words, k=3, inits=2) for _ in range(2))
    label = {r["doc_idx"]: r["cluster"] for r in one.assigned.collect()}
    assert label == {r["doc_idx"]: r["cluster"] for r in two.assigned.collect()}
    assert sum(r["n"] for r in clusters.sizes(one.assigned).collect()) == 200
    assert one.terms.count() == 36
    # the silhouette, plainly
    x = np.array([r["features"].toArray() for r in vectors.orderBy("doc_idx").collect()])
    y = np.array([label[i] for i in range(200)])
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    s = []
    for i in range(200):
        own = (y == y[i]).sum()
        if own == 1:
            s.append(0.0)
            continue
        a, b = d[i][y == y[i]].sum() / (own - 1), min(d[i][y == c].mean() for c in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    has = {r["doc_idx"] for r in model.weights().select("doc_idx").distinct().collect()}
    if len(has) == 200:
        assert abs(clusters.silhouette(model, one.assigned, rows=60) - np.mean(s)) < 1e-6


def test_analysis_end_to_end(spark, data, tmp_path):
    articles = articles_from_documents(spark.read.parquet(f"{data}/documents.parquet").limit(60))
    done = analyze(articles, Config(num_topics=2, num_clusters=2, inits=1))
    assert done.table.columns == [*ANALYZED.names, "doc_idx"] and done.table.count() == 60
    analyzer = Analyzer(spark, Config(num_topics=2, num_clusters=2, inits=1))
    for early in (analyzer.analyze, lambda: analyzer.save("x"), lambda: analyzer.search("a"), lambda: analyzer.save_raw("x"), analyzer.flagged):
        with pytest.raises(ValueError):
            early()
    analyzer.load(articles)
    analyzer.save_raw(str(tmp_path / "raw.csv"))
    analyzer.analyze()
    assert analyzer.save(str(tmp_path / "out.csv"), str(tmp_path / "lex.json"))["total_noticias"] == 60
    assert analyzer.search("the", 5).count() <= 5


def test_analysis_without_terms(spark):
    one = spark.createDataFrame([(0, "t", "c")], "doc_idx long, titulo string, contenido string")
    row = analyze(one).table.first()
    assert (row["most_similar_doc_idx"], row["max_similarity"], row["topic_id"]) == (-1, 0.0, None)


def test_an_analysis_that_fails_has_no_result(spark, monkeypatch):
    """A failed step shows; what was not clustered has no cluster, though the articles came with cluster 0."""
    docs = spark.createDataFrame([(i, f"red{i % 2} blue{i % 2}\ngreen", "s") for i in range(4)], "doc_id long, text string, source string")
    for part in (topics, clusters):
        with monkeypatch.context() as m:
            m.setattr(part, "fit", lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                analyze(articles_from_documents(docs), Config(num_topics=2, num_clusters=2, inits=1))
    row = analyze(articles_from_documents(docs.limit(1))).table.first()
    assert (row["cluster"], row["topic_id"]) == (None, None)


def test_service(spark, data, tmp_path):
    service = Service(spark, f"file://{tmp_path}/t.parquet")
    with pytest.raises(NoData):
        service.stats()
    articles = articles_from_documents(spark.read.parquet(f"{data}/documents.parquet").limit(30))
    assert service.analyze(articles, Config(num_topics=2, num_clusters=2, inits=1))["total_noticias"] == 30
    assert service.page(1, 7)["total_pages"] == 5 and service.health()["data_loaded"]
    assert service.search("the")["resultados"] >= 0
    assert len(open(service.export_csv(str(tmp_path / "e.csv"))).readline().split(",")) == len(ANALYZED.names)


def test_http(spark, data, tmp_path):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import urlopen

    from tidewire.plans.http import make_server

    articles = articles_from_documents(spark.read.parquet(f"{data}/documents.parquet").limit(30))
    service = Service(spark, f"file://{tmp_path}/t.parquet")
    server = make_server(service, lambda: articles)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path):
        try:
            with urlopen(base + path) as r:
                return r.status, r.read()
        except HTTPError as e:
            return e.code, e.read()

    assert get("/api/stats")[0] == 404 and get("/health")[0] == 200
    real = service.analyze
    service.analyze = lambda found: real(found, Config(num_topics=2, num_clusters=2, inits=1))
    code, answer = get("/api/analyze")
    assert code == 200 and json.loads(answer)["status"] == "success" and json.loads(answer)["stats"]["total_noticias"] == 30
    assert json.loads(get("/api/stats")[1])["total_noticias"] == 30
    assert len(json.loads(get("/api/noticias?page=2&per_page=7")[1])["noticias"]) == 7
    assert [get(p)[0] for p in ("/api/search?q=the", "/api/search?q=", "/api/search?q=a(", "/nowhere", "/api/noticias?page=x")] == [200, 400, 400, 404, 500]
    assert get("/api/export/csv")[1].startswith(b"titulo,")
    server.shutdown()


def test_registered_models_run_whole(spark, data, monkeypatch):
    """The registered queries run the operators' defaults: 20 passes, 10 starts."""
    import inspect

    from tidewire.plans import queries

    class Seen(Exception):
        pass

    def spy(real):
        def call(*args, **kw):
            bound = inspect.signature(real).bind(*args, **kw)
            bound.apply_defaults()
            raise Seen(bound.arguments)

        return call

    monkeypatch.setattr(queries, "_fits", {})  # no fit of another test's
    monkeypatch.setattr(queries, "_vectors", lambda spark, sf_dir: (None, None, []))
    monkeypatch.setattr(queries.topics, "fit", spy(topics.fit))
    monkeypatch.setattr(queries.clusters, "fit", spy(clusters.fit))
    for name in ("lda_topics", "topic_catalogue", "kmeans_clusters", "cluster_sizes", "cluster_terms", "silhouette"):
        with pytest.raises(Seen) as found:
            getattr(queries, name)(spark, data)
        seen = found.value.args[0]
        assert seen.get("passes", 20) == 20 and seen.get("inits", 10) == 10
