"""The jobs from the command line: ``spark-submit`` or ``python -m manchete``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from manchete import schema as S
from manchete.operators.search_index import search_index, write_search_index
from manchete.plans.capture import declared_pages, run_capture
from manchete.plans.cleaning import EXTRA_TABLES, run_cleaning
from manchete.plans.text_statistics import ROW_ID, run_text_statistics
from manchete.sinks.csv_tables import write_counts, write_csv
from manchete.sources.news_csv import read_news_csv
from manchete.sources.site_profile import SiteProfile
from manchete.workspace import job_folders


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="manchete", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    capture = jobs.add_parser("capture", help="captured pages (Parquet) to an article CSV")
    capture.add_argument("list_pages", help="table with page_no and html")
    capture.add_argument("article_pages", help="table with page_id, url and html")
    capture.add_argument("output")
    capture.add_argument("--base-url", required=True, help="address relative links belong to")
    limit = capture.add_mutually_exclusive_group()
    limit.add_argument("--pages", type=int, help="only the first result pages")
    limit.add_argument("--articles", type=int, help="only the first articles")
    capture.add_argument(
        "--past-empty-pages", action="store_true", help="go on after the first result page without hits"
    )
    capture.add_argument("--term", help="only articles whose title, subtitle or text holds this term")
    capture.add_argument(
        "--video-address", action="append", default=[], help="address part that marks a frame as a video; may repeat"
    )

    clean = jobs.add_parser("clean", help="raw CSV to cleaned table, monthly and yearly counts")
    clean.add_argument("csv")
    clean.add_argument("output", help="folder for the three tables")
    clean.add_argument("--start", default=S.RANGE_START)
    clean.add_argument("--end", default=S.RANGE_END)
    clean.add_argument(
        "--also", nargs="*", default=[], choices=EXTRA_TABLES, help="further tables to write into the folder"
    )

    stats = jobs.add_parser("stats", help="CSV to term statistics, tag chart and word clouds")
    stats.add_argument("csv")
    stats.add_argument("output", help="folder for the tables")
    stats.add_argument("--two-pass", action="store_true", help="read the texts twice and shuffle fewer n-grams")

    index = jobs.add_parser("index", help="CSV to a search index")
    index.add_argument("csv")
    index.add_argument("output", help="folder for the index")

    search = jobs.add_parser("search", help="articles of a search index that hold a term, as CSV")
    search.add_argument("index", help="folder of the index")
    search.add_argument("term")
    search.add_argument("output")
    return parser.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    with job_folders(spark):
        _run(spark, args)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "capture":
        list_pages = spark.read.parquet(args.list_pages)
        profile = SiteProfile(args.base_url).with_video_addresses(*args.video_address)
        limited = args.pages is not None or args.articles is not None
        run_capture(
            list_pages,
            spark.read.parquet(args.article_pages),
            profile,
            args.output,
            term=args.term,
            max_pages=args.pages,
            max_articles=args.articles,
            total_pages=declared_pages(list_pages, profile) if limited else None,
            until_empty=not args.past_empty_pages,
        )
    elif args.job == "clean":
        names = ("clean", "monthly", "yearly")
        paths = [f"{args.output}/{n}" for n in names]
        extras = {n: f"{args.output}/{n}" for n in args.also}
        run_cleaning(spark, args.csv, *paths, args.start, args.end, extras)
    elif args.job == "index":
        write_search_index(read_news_csv(spark, args.csv, row_id=ROW_ID), args.output, ROW_ID)
    elif args.job == "search":
        found = search_index(spark, args.index, args.term)
        write_csv(found.orderBy(ROW_ID).drop(ROW_ID), args.output)
    else:
        tables = run_text_statistics(spark, args.csv, f"{args.output}/term_stats", args.two_pass)
        for name, table in tables.items():  # at most a hundred rows per cloud, twenty tags
            write_counts(table.orderBy(table.columns[0], "posicao"), f"{args.output}/{name}")


if __name__ == "__main__":
    run(SparkSession.builder.appName("manchete").getOrCreate(), arguments())
