import pytest
from pyspark.sql import functions as F

from tidewire.functions.lexicon import Lexicon
from tidewire.operators import search, serving


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["Abc", "a.c", None, "STRASSE", "10% off"]
    return spark.createDataFrame([(i, t, t, None, "f", "Si" if i % 2 else "No", 0) for i, t in enumerate(texts)], "doc_idx long, titulo string, contenido string, fecha string, fuente string, menores_identificados string, cluster int")


def ids(df):
    return [r["doc_idx"] for r in df.orderBy("doc_idx").collect()]


def test_pattern_and_literal(rows):
    none = Lexicon([])
    assert ids(search.search_pattern(rows, "a.c", none)) == [0, 1]
    assert ids(search.search_words(rows, "a.c", none)) == [1]
    assert ids(search.search_words(rows, "straße", none)) == [3]
    with pytest.raises(search.InvalidQuery):
        search.search_pattern(rows, "a(", none)
    with pytest.raises(search.InvalidQuery):
        search.search_pattern(rows, "  ", none)


def test_words_are_any_of(rows):
    assert ids(search.search_words(rows, "off abc", Lexicon([["off", "strasse"]]))) == [0, 3, 4]


def test_api(rows):
    found = search.search_api(rows, "abc", Lexicon([["abc", "off"]]))
    assert found["resultados"] == 2 and found["synonyms_used"] == ["abc", "off"]
    assert found["noticias"][0] == {"id": 0, "titulo": "Abc", "contenido": "Abc", "fecha": None, "fuente": "f", "menores_identificados": "No", "cluster": 0, "topic_id": -1, "similitud": 0.0}


def test_top_has_fixed_columns(rows):
    assert search.search_top(rows, "abc", Lexicon([])).columns == list(search.RESULT)


def test_pages(rows):
    assert [n["id"] for n in serving.page(rows, 2, 2)["noticias"]] == [2, 3]
    one = serving.page(rows, 1, 1, only_flagged=True)
    assert (one["total"], one["total_pages"], one["noticias"][0]["id"]) == (2, 2, 1)
    assert serving.page(rows, 0)["noticias"] == []
    with pytest.raises(ValueError):
        serving.page(rows, 1, 0)


def test_stats(rows, spark):
    s = serving.stats(rows)
    assert (s["total_noticias"], s["noticias_nna"], s["clusters"], s["topics"], s["similitud_promedio"]) == (5, 2, 1, 0, 0.0)
    assert serving.flag_percentage(rows).first()[0] == 40.0
    assert serving.flag_percentage(rows.limit(0)).first()[0] == 0.0
    assert serving.health(None)["data_size"] == 0


def test_lexicon(spark, tmp_path):
    lex = Lexicon()
    counts = {"denuncia": 20, "querella": 20, "investigación": 20, "justicia": 17, "acusación": 4, "pesquisa": 3, "nna": 32}
    assert {t: len(lex.get(t)) - 1 for t in counts} == counts
    assert len(lex.synonyms) == 143 and sum(map(len, lex.synonyms.values())) == 2106
    assert lex.get(" Zzz ") == {"zzz"}
    assert set(lex.find("Solo hay que decir algo difícil sobre el criminal")) == {"dif", "criminal"}
    assert lex.expand("la pesquisa") == "la (averiguación OR indagatoria OR investigación OR pesquisa)"
    assert {(r["term"], r["synonym"]) for r in lex.edges(spark).collect()} == {(t, s) for t, found in lex.synonyms.items() for s in found}
    df = spark.createDataFrame([("La Pesquisa",), (None,)], "q string")
    assert [r[0] for r in df.select(lex.expand_column("q")).collect()] == [lex.expand("La Pesquisa"), ""]
    assert df.select(lex.terms_in(F.lit("difícil")).alias("t")).first()["t"] == ["dif"]
    lex.save(str(tmp_path / "l.json"))
    other = Lexicon([])
    assert other.load(str(tmp_path / "l.json")) and other.synonyms == lex.synonyms
    assert not other.load(str(tmp_path / "absent.json")) and other.synonyms == lex.synonyms
