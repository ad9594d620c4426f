import re
import unicodedata
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.functions.detect import detect


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("exact", [False, True])
def test_clean_text(spark, exact):
    cases = {"Educación en México: 3 niños": "educacio n en me xico 3 nin os", "L'été œuvre ß": "l e te œuvre ß", None: "", "": "", " \n\t ": ""}
    assert values(spark, list(cases), lambda c: text.clean_text(c, exact=exact)) == list(cases.values())


def test_clean_text_exact_forms(spark):
    assert values(spark, ["Ñandú_x  ½ ² ﬁn"], lambda c: text.clean_text(c, exact=True)) == ["n andu _x 1 2 2 fin"]


def test_clean_text_fixed(spark):
    assert values(spark, ["Educación: niños"], lambda c: text.clean_text(c, compat=False)) == ["educacion ninos"]


def test_text_against_the_standard_library(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("text", text.clean_text("text").alias("c"), text.fold_ascii("text").alias("f")).collect()
    for r in rows:
        assert r["c"] == " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", r["text"]).lower()).split())
        assert r["f"] == unicodedata.normalize("NFKD", r["text"].lower()).encode("ascii", "ignore").decode()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=20))
def test_exact_forms_for_any_text(spark, texts):
    texts = [t for t in texts if "\x00" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t) and "ſ" not in t and t.lower().upper().lower() == t.lower()]
    got = values(spark, texts, lambda c: text.fold_ascii(c, exact=True)) if texts else []
    assert got == [unicodedata.normalize("NFKD", t.lower()).encode("ascii", "ignore").decode() for t in texts]


def test_preview(spark):
    assert values(spark, ["a" * 200, "a" * 201, None], text.preview) == ["a" * 200, "a" * 200 + "...", ""]


def test_strip_html(spark):
    page = "<p> a <b>b</b></p><!-- c --><script>var t='</p>';</script><style>p{}</style> x &amp; y"
    assert values(spark, [page, None, "plain"], text.strip_html) == ["a b x & y", "", "plain"]
    assert values(spark, [page + " &eacute;&#233;"], lambda c: text.strip_html(c, exact=True)) == ["a b x & y éé"]


def test_dates(spark):
    cases = ["Tue, 30 Sep 2025 16:16:34 -0600", "Wed, 1 Oct 2025 01:02:03 GMT", "nonsense", None]
    got = values(spark, cases, lambda c: F.unix_timestamp(text.parse_pubdate(c)))
    assert got == [int(datetime.fromisoformat(d).timestamp()) if d else None for d in ("2025-09-30T22:16:34+00:00", "2025-10-01T01:02:03+00:00", None, None)]
    iso = values(spark, cases, text.iso_date)
    assert iso[:2] == ["2025-09-30T16:16:34-06:00", "2025-10-01T01:02:03+00:00"]
    assert abs((datetime.fromisoformat(iso[2]) - datetime.now(UTC).replace(tzinfo=None)).total_seconds()) < 300


YES = ["menores de edad", "menor costo", "una nia y un nio", "15 años", "12años", "3 meses", "de 2 mes", "infantes", "huérfanas", "recién nacida", "bebé", "NNA", "nna"]
NO = ["Dos niños", "la niña", "Niño", "100 años", "el mes", "2024 mes", "hijito", "infantiles", "adolescencia", None, ""]


def test_detector(spark):
    assert values(spark, YES, detect) == ["Si"] * len(YES)
    assert values(spark, NO, detect) == ["No"] * len(NO)
    assert values(spark, ["Dos niños", "la niña", "el mes"], lambda c: detect(c, compat=False)) == ["Si", "Si", "No"]


def test_query_words(spark):
    assert values(spark, ["  A b\tC ", " ", None], text.query_words) == [["a", "b", "c"], [], []]
