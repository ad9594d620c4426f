import json

from pyspark.sql import functions as F

from tidewire.operators import history
from tidewire.schema import ARTICLES, conform, with_doc_idx
from tidewire.sources import feeds, tables
from tidewire.streaming.ingest import upsert_stream


def test_keep_last(spark):
    df = spark.createDataFrame([(1, "x", "1"), (2, "y", "1"), (3, "x", "1"), (4, None, None), (5, None, None)], "doc_idx long, titulo string, contenido string")
    for f in (history.dedup_keep_last, history.dedup_window):
        once = f(df)
        assert sorted(r["doc_idx"] for r in once.collect()) == [2, 3, 5]
        assert sorted(r["doc_idx"] for r in f(once).collect()) == [2, 3, 5]


def test_append(spark):
    old = spark.createDataFrame([(0, "x", "1", 7.0), (1, "y", "1", 8.0)], "doc_idx long, titulo string, contenido string, max_similarity double")
    new = spark.createDataFrame([(0, "x", "1"), (1, "z", "1")], "doc_idx long, titulo string, contenido string")
    got = with_doc_idx(history.append_keep_last(old, new).drop("doc_idx"), "__order").orderBy("doc_idx").collect()
    assert [(r["doc_idx"], r["titulo"], r["max_similarity"]) for r in got] == [(0, "y", 8.0), (1, "x", None), (2, "z", None)]


def test_doc_idx_is_contiguous(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1009).alias("k"))
    got = with_doc_idx(df, "k").orderBy("k").collect()
    assert [r["doc_idx"] for r in got] == list(range(1000))
    assert with_doc_idx(df.limit(0), "k").count() == 0


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "q", b', "line1\nline2", "", "f", "2025", 0, "Si"), ("NA", None, "x", "f", "2025", 1, "No")]
    df = spark.createDataFrame(rows, ARTICLES)
    tables.write_csv(df, str(tmp_path / "a.csv"), single=True)
    back = tables.read_csv(spark, str(tmp_path / "a.csv")).orderBy("cluster").collect()
    assert [r["titulo"] for r in back] == ['a "q", b', "NA"] and back[0]["contenido"] == "line1\nline2"
    assert back[1]["contenido"] is None and back[0]["cluster"] == 0
    assert tables.load(spark, str(tmp_path / "absent.csv")) is None


def test_publish_over_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    tables.publish(spark.range(3), path)
    tables.publish(spark.read.parquet(path).unionByName(spark.range(3, 5)), path)
    assert spark.read.parquet(path).count() == 5


def test_save_results(spark, tmp_path):
    df = conform(spark.createDataFrame([(0, "t", "c", "Si")], "doc_idx long, titulo string, contenido string, menores_identificados string"))
    about = tables.save_results(df, str(tmp_path / "out.csv"))
    assert (about["total_noticias"], about["noticias_con_nna"]) == (1, 1)
    assert json.load(open(tmp_path / "out_metadata.json"))["columnas_disponibles"] == ARTICLES.names


FEED = """<?xml version="1.0" encoding="UTF-8"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<item><title> One </title><description>short</description><content:encoded>&lt;p&gt;Long &lt;b&gt;body&lt;/b&gt;&lt;/p&gt;</content:encoded><link>http://x/1</link><pubDate>Tue, 30 Sep 2025 16:16:34 -0600</pubDate></item>
<item><title>Two</title><description>una nia</description></item>
<item><title>No description</title></item>
</channel></rss>"""


def test_feed_files_and_source(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    (tmp_path / "bad.xml").write_text("no feed")
    landed = feeds.collect_landed(spark, [str(tmp_path / "f.xml"), str(tmp_path / "bad.xml")]).collect()

    def fetch(url):
        if "bad" in url:
            raise OSError("down")
        return FEED.encode()

    fetched = feeds.collect_feeds(spark, ["http://a/", "http://bad/", "http://b/"], fetch).orderBy("doc_idx").collect()
    assert len(landed) == 2 and [r["fuente"] for r in fetched] == ["http://a/"] * 2 + ["http://b/"] * 2
    for rows in (sorted(landed, key=lambda r: r["doc_idx"]), fetched):
        assert [r["titulo"] for r in rows[:2]] == ["One", "Two"]
        assert rows[0]["contenido"] == "Long body" and rows[0]["fecha"] == "2025-09-30T16:16:34-06:00"
        assert rows[1]["contenido"] == "una nia" and rows[1]["enlace"] == ""
        assert [r["doc_idx"] for r in rows] == list(range(len(rows)))


def test_stream_keeps_the_newest(spark, tmp_path):
    land, path, state = tmp_path / "land", f"file://{tmp_path}/t.parquet", str(tmp_path / "state")
    land.mkdir()
    (land / "1.xml").write_text(FEED)
    upsert_stream(spark, str(land), path, state).awaitTermination()
    (land / "2.xml").write_text(FEED.replace("http://x/1", "http://x/new"))
    upsert_stream(spark, str(land), path, state).awaitTermination()
    rows = spark.read.parquet(path).orderBy("doc_idx").collect()
    assert sorted(r["titulo"] for r in rows) == ["One", "Two"]
    assert {r["titulo"]: r["enlace"] for r in rows}["One"] == "http://x/new"
    assert {r["titulo"]: r["menores_identificados"] for r in rows} == {"One": "No", "Two": "Si"}


def test_a_publication_cut_short_loses_nothing(spark, tmp_path, monkeypatch):
    """Stopped after each step in turn, the next load gives the old table or the new one, whole."""
    import pytest

    path = f"file://{tmp_path}/t.parquet"
    tables.publish(spark.range(3), path)
    real, steps = tables._hadoop, []

    class Stop(Exception):
        pass

    class Halting:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            def call(*args):
                if name in ("rename", "delete", "create"):
                    if len(steps) >= allowed:
                        raise Stop
                    steps.append(name)
                return getattr(self.fs, name)(*args)

            return call

    def hadoop(session, at):
        fs, where = real(session, at)
        return Halting(fs), where

    done = False
    for allowed in range(12):
        before = tables.load(spark, path).count()
        steps.clear()
        monkeypatch.setattr(tables, "_hadoop", hadoop)
        try:
            tables.publish(spark.range(before + 10), path)
            done = True
        except Stop:
            pass
        monkeypatch.setattr(tables, "_hadoop", real)
        after = tables.load(spark, path)
        assert after is not None and after.count() in (before, before + 10)
        if done:
            assert after.count() == before + 10
            break
    assert done and allowed >= 3
    (tmp_path / "broken.parquet").mkdir()
    (tmp_path / "broken.parquet" / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception):  # noqa: B017
        tables.load(spark, f"file://{tmp_path}/broken.parquet").count()
    assert tables.load(spark, f"file://{tmp_path}/absent.parquet") is None


def test_the_last_of_equal_articles_is_the_last_fetched(spark, tmp_path):
    from tidewire.streaming.ingest import merge

    path = f"file://{tmp_path}/t.parquet"
    merge(spark.range(1).selectExpr("0L as doc_idx", "'x' as titulo", "'y' as contenido", "'first' as enlace"), path, "doc_idx")
    rows = spark.range(0, 400, 1, 8).selectExpr("id as doc_idx", "concat('t', id % 7) as titulo", "'c' as contenido", "concat('at ', id) as enlace")
    merge(rows, path, "doc_idx")
    got = tables.load(spark, path).orderBy("doc_idx").collect()
    assert [(r["doc_idx"], r["enlace"]) for r in got] == [(0, "first"), *[(k + 1, f"at {i}") for k, i in enumerate(range(393, 400))]]


def test_references_are_decoded_by_default(spark, tmp_path):
    feed = FEED.replace("short", "short").replace("&lt;b&gt;body&lt;/b&gt;", "b&amp;eacute;b&amp;eacute; &amp;#8217;x&amp;#8217;")
    (tmp_path / "f.xml").write_text(feed)
    rows = feeds.collect_landed(spark, [str(tmp_path / "f.xml")]).orderBy("doc_idx").collect()
    assert rows[0]["contenido"] == "Long bébé ’x’"


def test_command_line(spark, tmp_path, monkeypatch):
    """collect, analyze and one round of the schedule, with feeds that are fetched from memory."""
    from tidewire import cli

    monkeypatch.setattr(cli, "collect_feeds", lambda session, urls: feeds.collect_feeds(session, urls, lambda url: FEED.encode()))
    out, path = f"file://{tmp_path}/out.parquet", f"file://{tmp_path}/a.parquet"
    assert cli.collect(spark, ["http://a/", "http://b/"], path) == 4  # a first batch is not deduplicated
    assert cli.collect(spark, ["http://a/"], path) == 2
    monkeypatch.setattr(cli, "analyze", lambda articles: type("A", (), {"table": conform(articles, extra=("doc_idx",))}))
    found = cli.run_analysis(spark, path, out)
    assert found["total_noticias"] == 2 and found["noticias_nna"] == 1 and found["porcentaje"] == 50.0
    cli.schedule(spark, ["http://a/"], path, out, rounds=1, poll_s=0)
    assert tables.load(spark, out).count() == 2
