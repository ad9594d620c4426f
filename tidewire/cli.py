"""Command line: collect, analyze, full, schedule or serve."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from .plans.pipeline import analyze, flag
from .sources.feeds import collect_feeds
from .sources.tables import load, publish
from .streaming.ingest import merge

log = logging.getLogger("tidewire")


def collect(spark: SparkSession, urls: list[str], path: str) -> int:
    """Fetches the feeds and merges them into the stored articles."""
    merge(flag(collect_feeds(spark, urls)), path, "doc_idx")
    return spark.read.parquet(path).count()


def run_analysis(spark: SparkSession, path: str, out: str) -> dict:
    """Analyses the stored articles, history included."""
    articles = load(spark, path)
    if articles is None:
        raise FileNotFoundError(path)
    table = analyze(articles).table
    publish(table, out)
    from .operators.serving import flag_percentage, stats

    done = spark.read.parquet(out)
    return {**stats(done), "porcentaje": round(flag_percentage(done).first()[0], 1)}


def schedule(spark: SparkSession, urls: list[str], path: str, out: str, collect_h: float = 6, analyze_h: float = 12, poll_s: float = 60, rounds: int | None = None) -> None:
    """Both at once, then each at its own pace; an error is logged and the loop goes on."""
    due = {"collect": 0.0, "analyze": 0.0}
    while rounds is None or rounds > 0:
        for name, hours, job in (("collect", collect_h, lambda: collect(spark, urls, path)), ("analyze", analyze_h, lambda: run_analysis(spark, path, out))):
            if time.monotonic() >= due[name]:
                due[name] = time.monotonic() + hours * 3600
                try:
                    log.info("%s: %s", name, job())
                except Exception:  # noqa: BLE001
                    log.exception(name)
        rounds = None if rounds is None else rounds - 1
        if rounds != 0:
            time.sleep(poll_s)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewire", description=__doc__)
    parser.add_argument("command", choices=["collect", "analyze", "full", "schedule", "serve"], nargs="?", default="schedule")
    parser.add_argument("--feeds", nargs="*", default=[])
    parser.add_argument("--articles", default="data/articles.parquet")
    parser.add_argument("--out", default="data/analyzed.parquet")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8000)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(message)s")
    spark = SparkSession.builder.appName("tidewire").getOrCreate()
    if args.command in ("collect", "full"):
        log.info("articles: %s", collect(spark, args.feeds, args.articles))
    if args.command in ("analyze", "full"):
        log.info("%s", run_analysis(spark, args.articles, args.out))
    if args.command == "serve":
        from .plans.http import make_server
        from .plans.service import Service

        make_server(Service(spark, args.out), lambda: spark.read.parquet(args.articles), args.host, args.port).serve_forever()
    if args.command == "schedule":
        schedule(spark, args.feeds, args.articles, args.out)


if __name__ == "__main__":
    main()
