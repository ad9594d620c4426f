"""RSS feeds as articles: from landed XML files, or over HTTP through a Python data source."""

from __future__ import annotations

import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import iso_date, strip_html, strip_title
from ..schema import UNDETERMINED, conform, with_doc_idx
from .scratch import written

ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "description", "content:encoded", "link", "pubDate")])
TIMEOUT_S = 10
AGENT = "Mozilla/5.0 (compatible; tidewire)"


def read_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The items of landed feed files, with ``feed`` (the file) and ``position`` in reading order. A file that can't be
    parsed gives no items."""
    items = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").option("ignoreCorruptFiles", "true").schema(ITEM).load(paths if isinstance(paths, str) else ",".join(paths))
    return items.select("*", F.col("_metadata.file_path").alias("feed"), F.monotonically_increasing_id().alias("position"))


def to_articles(items: DataFrame, exact: bool = True) -> DataFrame:
    """Items that have a title and a description, as articles (without doc_idx). The body is content:encoded where the
    item has it, even if empty."""
    body = F.coalesce(F.col("`content:encoded`"), F.col("description"))
    return items.where(F.col("title").isNotNull() & F.col("description").isNotNull()).select(
        strip_title("title").alias("titulo"),
        strip_html(body, exact).alias("contenido"),
        F.coalesce("link", F.lit("")).alias("enlace"),
        F.col("feed").alias("fuente"),
        iso_date("pubDate").alias("fecha"),
        F.lit(0).alias("cluster"),
        F.lit(UNDETERMINED).alias("menores_identificados"),
        *[c for c in ("feed_order", "position", "landed") if c in items.columns],
    )


def collect_landed(spark: SparkSession, paths: list[str], exact: bool = True) -> DataFrame:
    """All feeds' articles, numbered by feed, then item. ``exact`` as in strip_html."""
    frames = [read_items(spark, p).withColumn("feed_order", F.lit(k)) for k, p in enumerate(paths)]
    if not frames:
        return conform(spark.createDataFrame([], ITEM)).withColumn("doc_idx", F.lit(None).cast("long")).limit(0)
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return conform(with_doc_idx(to_articles(written(out, "items"), exact), "feed_order", "position"))


# --- over HTTP -----------------------------------------------------------------------------------------------------


def fetch_http(url: str) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:  # noqa: S310
        return answer.read()


def parse_feed(data: bytes) -> Iterator[tuple[str | None, ...]]:
    """The items' elements in ITEM's order; absent ones are None, empty ones ''."""
    encoded = "{http://purl.org/rss/1.0/modules/content/}encoded"
    for item in ET.fromstring(data).iter("item"):
        found = [item.find(t) for t in ("title", "description", encoded, "link", "pubDate")]
        yield tuple(None if e is None else "".join(e.itertext()) for e in found)


class FeedPartition(InputPartition):
    def __init__(self, order: int, url: str) -> None:
        super().__init__(order)
        self.order, self.url = order, url


class FeedReader(DataSourceReader):
    def __init__(self, urls: list[str], fetch: Callable[[str], bytes]) -> None:
        self.urls, self.fetch = urls, fetch

    def partitions(self) -> list[FeedPartition]:
        return [FeedPartition(k, u) for k, u in enumerate(self.urls)]

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        try:
            items = list(parse_feed(self.fetch(partition.url)))
        except Exception as e:  # noqa: BLE001  a feed that fails gives no rows, and the others go on
            print(f"{partition.url}: {e}")
            return
        for k, item in enumerate(items):
            yield (*item, partition.url, k, partition.order)


def feed_source(fetch: Callable[[str], bytes] = fetch_http) -> type[DataSource]:
    """A data source named rss, one partition for each feed; ``fetch`` gets a URL and gives bytes."""

    class RssDataSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "rss"

        def schema(self) -> T.StructType:
            return T.StructType([*ITEM.fields, T.StructField("feed", T.StringType()), T.StructField("position", T.LongType()), T.StructField("feed_order", T.IntegerType())])

        def reader(self, schema: T.StructType) -> FeedReader:
            return FeedReader([u for u in self.options.get("urls", "").split("\n") if u], fetch)

    return RssDataSource


def collect_feeds(spark: SparkSession, urls: list[str], fetch: Callable[[str], bytes] = fetch_http) -> DataFrame:
    """All feeds' articles, numbered by feed, then item. Nothing is deduplicated."""
    spark.dataSource.register(feed_source(fetch))
    # fetched once; what is fetched again could differ
    items = spark.read.format("rss").option("urls", "\n".join(urls)).load()
    return conform(with_doc_idx(to_articles(written(items, "feeds")), "feed_order", "position"))
