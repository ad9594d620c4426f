"""The service: a table in memory, and the answers of serving.py and search.py over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.lexicon import Lexicon
from ..operators import search, serving
from ..sources import tables
from .pipeline import Config, analyze


class NoData(LookupError):
    """No table is loaded."""


class Service:
    def __init__(self, spark: SparkSession, path: str, lexicon: Lexicon | None = None) -> None:
        self.spark, self.path, self.lexicon = spark, path, lexicon or Lexicon()
        self.table: DataFrame | None = None
        self.load()

    def load(self) -> bool:
        found = tables.load(self.spark, self.path)
        if found is None:
            return False
        if self.table is not None:
            self.table.unpersist()
        self.table = found.persist()
        return True

    def _data(self) -> DataFrame:
        if self.table is None:
            raise NoData("no data")
        return self.table

    def stats(self) -> dict:
        return serving.stats(self._data())

    def page(self, page: int = 1, per_page: int = 10, only_flagged: bool = False) -> dict:
        return serving.page(self._data(), int(page), int(per_page), only_flagged)

    def search(self, query: str) -> dict:
        return search.search_api(self._data(), query, self.lexicon)

    def analyze(self, articles: DataFrame, config: Config | None = None) -> dict:
        """Runs the analysis (5 topics, 4 clusters unless told otherwise), publishes and loads it."""
        out = analyze(articles, config or Config(num_topics=5, num_clusters=4)).table
        tables.publish(out, self.path)
        self.load()
        return self.stats()

    def export_csv(self, path: str) -> str:
        data = self._data()
        tables.write_csv(data.orderBy("doc_idx").drop("doc_idx"), path, single=True)
        return path

    def health(self) -> dict:
        return serving.health(self.table)
