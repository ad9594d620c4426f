"""The analysis of an articles table, and the façade that keeps its steps in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import detect
from ..functions.lexicon import Lexicon
from ..functions.text import clean_text
from ..operators import clusters, search, similarity, topics
from ..operators.vectorize import Tfidf
from ..schema import ANALYZED, YES, conform
from ..sources import tables
from ..sources.scratch import written


@dataclass
class Config:
    num_topics: int = 6
    num_clusters: int = 5
    inits: int = 10
    compat: bool = True
    exact: bool = False  # full decomposition of letters beyond Latin, by an Arrow UDF on the texts that have them
    seed: int = 42


@dataclass
class Analysis:
    table: DataFrame
    topics: topics.Topics | None
    clusters: clusters.Clusters | None


def flag(articles: DataFrame, compat: bool = True, exact: bool = False) -> DataFrame:
    return articles.withColumn("menores_identificados", detect("contenido", compat, exact))


def clean(articles: DataFrame, compat: bool = True, exact: bool = False) -> DataFrame:
    return articles.withColumns({"titulo_limpio": clean_text("titulo", compat, exact), "contenido_limpio": clean_text("contenido", compat, exact)})


def analyze(articles: DataFrame, config: Config | None = None) -> Analysis:
    """Flags, cleans, and adds topics, clusters and neighbours; all parts meet on doc_idx. A step that fails fails the
    analysis. Without any term there are no topics and no clusters: their columns are null, whatever cluster the articles
    came with."""
    config = config or Config()
    base = clean(flag(articles, config.compat, config.exact), config.compat, config.exact).drop("cluster")
    model = Tfidf(base)
    out, found_topics, found_clusters = base, None, None
    some = model.vocab.count() > 0
    if some:
        vectors, words = model.vectors()
        vectors = vectors.persist()
        found_topics = topics.fit(vectors, words, config.num_topics, seed=config.seed)
        out = out.join(topics.describe(found_topics.assigned, found_topics.catalogue), "doc_idx", "left")
        found_clusters = clusters.fit(vectors, words, config.num_clusters, config.seed, config.inits)
        out = out.join(found_clusters.assigned, "doc_idx", "left")
    out = out.join(similarity.nearest(model), "doc_idx", "left")
    # the result no longer needs what was kept for the fits
    table = written(conform(out, ANALYZED), "analysis")
    if some:
        vectors.unpersist()
    model.close()
    return Analysis(table, found_topics, found_clusters)


class Analyzer:
    """The steps in order; one that comes too early raises ValueError."""

    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.lexicon = Lexicon()
        self.articles: DataFrame | None = None
        self.analysis: Analysis | None = None

    def load(self, articles: DataFrame) -> DataFrame:
        self.articles = flag(articles, self.config.compat, self.config.exact)
        return self.articles

    def _need(self, what, name: str):
        if what is None:
            raise ValueError(f"{name} comes first")
        return what

    def save_raw(self, path: str) -> None:
        articles = self._need(self.articles, "load")
        tables.write_csv(articles.orderBy("doc_idx").drop("doc_idx"), path, single=True)

    def analyze(self) -> DataFrame:
        self.analysis = analyze(self._need(self.articles, "load"), self.config)
        return self.analysis.table

    def save(self, path: str, lexicon_path: str | None = None) -> dict:
        about = tables.save_results(self._need(self.analysis, "analyze").table, path)
        if lexicon_path:
            self.lexicon.save(lexicon_path)
        return about

    def search(self, query: str, max_results: int = 10) -> DataFrame:
        return search.search_top(self._need(self.analysis, "analyze").table, query, self.lexicon, max_results)

    def run(self, articles: DataFrame, path: str | None = None, raw_path: str | None = None) -> DataFrame:
        self.load(articles)
        if raw_path:
            self.save_raw(raw_path)
        table = self.analyze()
        if path:
            self.save(path)
        return table

    def flagged(self) -> int:
        return self._need(self.articles, "load").where(F.col("menores_identificados") == YES).count()
