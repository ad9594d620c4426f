"""Searches over articles: one predicate, one scan. Results are in row order; there is no ranking."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.text import preview

COLUMNS = ("titulo", "contenido")
RESULT = ("titulo", "fecha", "fuente", "cluster", "topic_id", "menores_identificados")


class InvalidQuery(ValueError):
    """A blank query, or one that is no valid pattern."""


def _any(predicates: list[Column]) -> Column:
    return reduce(or_, predicates) if predicates else F.lit(False)


def contains_literal(c: str, term: str) -> Column:
    """Contains, whatever the case (both sides in capitals, so that a sharp s equals SS); false for null."""
    return F.coalesce(F.contains(F.upper(F.col(c)), F.upper(F.lit(term))), F.lit(False))


def matches(c: str, pattern: str) -> Column:
    """Matches a Java pattern anywhere, whatever the case; false for null."""
    return F.coalesce(F.col(c).rlike(f"(?iu){pattern}"), F.lit(False))


def words_predicate(query: str, lexicon: Lexicon, columns: tuple[str, ...] = COLUMNS, present: list[str] | None = None) -> Column:
    """Any column contains the whole query, one of its words or a synonym of one of them, literally."""
    words = query.lower().split()
    terms = {query, *words, *(s for w in words for s in lexicon.get(w))} - {""}
    there = [c for c in columns if present is None or c in present]
    return _any([contains_literal(c, t) for c in there for t in sorted(terms)])


def search_words(df: DataFrame, query: str, lexicon: Lexicon | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The rows that :func:`words_predicate` selects. An absent column is passed over."""
    return df.where(words_predicate(query, lexicon or Lexicon(), columns, df.columns))


def search_top(df: DataFrame, query: str, lexicon: Lexicon | None = None, max_results: int = 10) -> DataFrame:
    """The first results in row order, in the columns of a search result."""
    found = search_words(df, query, lexicon).orderBy("doc_idx").limit(max_results)
    return found.select(*[c if c in df.columns else F.lit(None).alias(c) for c in RESULT])


def check_pattern(df: DataFrame, query: str) -> None:
    """The pattern is tried on one literal row, so that a bad one fails before the scan."""
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(f"(?iu){query}")).collect()
    except PySparkException as e:
        raise InvalidQuery(f"not a valid pattern: {query!r}") from e


def search_pattern(df: DataFrame, query: str, lexicon: Lexicon | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Rows where a column matches the query, as a pattern, or a synonym of the whole query."""
    if not query or not query.strip():
        raise InvalidQuery("a query is needed")
    query = query.strip()
    check_pattern(df, query)
    terms = [query, *sorted((lexicon or Lexicon()).get(query) - {query})]
    return df.where(_any([matches(c, t) for c in columns if c in df.columns for t in terms]))


def records(df: DataFrame) -> DataFrame:
    """Rows as the service shows them; absent analysis columns get their defaults."""

    def or_else(c: str, value) -> Column:
        return F.coalesce(F.col(c), F.lit(value)) if c in df.columns else F.lit(value)

    return df.select(
        F.col("doc_idx").alias("id"),
        "titulo",
        preview("contenido").alias("contenido"),
        "fecha",
        "fuente",
        "menores_identificados",
        or_else("cluster", -1).cast("int").alias("cluster"),
        or_else("topic_id", -1).cast("int").alias("topic_id"),
        or_else("max_similarity", 0.0).cast("double").alias("similitud"),
    )


def search_api(df: DataFrame, query: str, lexicon: Lexicon | None = None, most: int = 20) -> dict:
    """Number of results, the first ``most`` records, and the synonyms used."""
    lexicon = lexicon or Lexicon()
    found = search_pattern(df, query, lexicon)
    rows = records(found.orderBy("doc_idx").limit(most)).collect()
    return {"query": query.strip(), "resultados": found.count(), "noticias": [r.asDict() for r in rows], "synonyms_used": sorted(lexicon.get(query.strip()))}

