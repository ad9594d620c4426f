import pytest


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of small tables with the awkward rows: nulls, empty and long texts, repeats, extra clashing columns."""
    at = str(tmp_path_factory.mktemp("tables"))
    long = " ".join(f"word{i % 97}" for i in range(30000))
    texts = ["the cat sat on the mat today", "the cat sat on the mat today", None, "", "   ", "!!! 123", "one", "two words", "ÀB cd\n\nef  gh ", long, "ÀB CD ef", "tail ", " head", "▁ mark", "<|endoftext|> x", "日本語 テキスト"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), "clash", 1.0) for i, t in enumerate(texts)]
    rows += [(1, texts[1], "en", "s1", 28, "clash", 2.0), (None, "no id", "de", "s1", 5, "clash", 2.0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, size double").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(14)] + [(3, None, None), (None, 1, True)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic").write.parquet(f"{at}/labels.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [float(i % 7), float(i % 3) - 1, 0.25 * (i % 5)], 0) for i in range(230)]
    vectors += [(300, None, 0), (400, [1.0, None, 0.0], 0), (500, [nan, 1.0, 1.0], 0), (600, [inf, 0.0, 0.0], 0), (700, [0.0, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (800, [1.0, 2.0], 0), (1, [1.0, 1.0, 1.0], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain & simple"), (4, "u", "<p>unclosed <b>bold"), (4, "u", "<div"), (None, "u", "<article><p>x</p></article>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, tables, tmp_path_factory):
    """The same tables without rows."""
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at
