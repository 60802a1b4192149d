"""Thin command line over the plans: ``python -m lectern.cli crawl|enrich|analyze|publish``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.functions import dims, text
from lectern.operators import aggregates
from lectern.plans import crawl, enrich, report
from lectern.session import cut
from lectern.sources import files, http, lookup


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="fetch paged responses and write papers")
    c.add_argument("--venues-table", required=True)
    pages = c.add_mutually_exclusive_group(required=True)
    pages.add_argument("--index-pages", help="Parquet of venue, body")
    pages.add_argument("--index-url", help="fetch the index pages; {} stands for a venue's folder")
    c.add_argument("--url", required=True)
    c.add_argument("-v", "--venues", nargs="*")
    c.add_argument("--since", type=int)
    c.add_argument("--until", type=int)
    c.add_argument("-o", "--out", default="data")
    c.add_argument("--formats", nargs="*", default=["jsonl", "csv"], choices=["jsonl", "csv", "sqlite"])
    c.add_argument("--per-venue", action="store_true")
    c.add_argument("--delay", type=float, default=3.0)
    c.add_argument("--max-delay", type=float, default=20.0)
    c.add_argument("--max-retries", type=int, default=6)
    c.add_argument("--user-agent", default="lectern")
    c.add_argument("--timeout", type=float, default=60.0)
    c.add_argument("--cache-dir")
    c.add_argument("--no-cache", action="store_true")
    c.add_argument("-q", "--quiet", action="store_true")
    c.add_argument("--debug", action="store_true")
    c.add_argument("--opener", help="module:function that answers instead of the network")
    c.add_argument("--cache-ttl-days", type=float)
    c.add_argument("--refresh", action="store_true")
    c.add_argument("--include-editorship", action="store_true")
    c.add_argument("--include-front-matter", action="store_true")
    c.add_argument("--list-venues", action="store_true")
    e = sub.add_parser("enrich", help="abstracts for papers")
    for name in ("papers", "works", "preprints"):
        e.add_argument(f"--{name}", required=name == "papers", help="Parquet; without it, works and preprints are looked up")
    e.add_argument("--url", help="where works are looked up")
    e.add_argument("--arxiv-url", help="where preprints are looked up")
    e.add_argument("--answers", help="folder that keeps the answers, so that a run can go on later")
    e.add_argument("--mailto", default="")
    e.add_argument("--opener", help="module:function that answers instead of the network")
    e.add_argument("--title-delay", type=float, default=1.0)
    e.add_argument("--cache-dir")
    e.add_argument("--no-cache", action="store_true")
    e.add_argument("-o", "--out", required=True)
    e.add_argument("--limit", type=int, default=0)
    e.add_argument("--no-title-match", action="store_true")
    e.add_argument("--no-arxiv", action="store_true")
    a = sub.add_parser("analyze", help="write the report")
    a.add_argument("--papers", required=True)
    a.add_argument("--venues-table", required=True)
    a.add_argument("-o", "--out", required=True)
    b = sub.add_parser("publish", help="inline the report into a template and write shards of abstracts")
    for name in ("report", "template", "papers", "venues-table", "abstracts"):
        b.add_argument(f"--{name}", required=True)
    b.add_argument("-o", "--out", required=True)
    b.add_argument("--shards", required=True)
    return p


def run_crawl(spark: SparkSession, a: argparse.Namespace) -> int:
    venues = spark.read.parquet(a.venues_table)
    known = {r.slug: r.asDict() for r in venues.collect()}
    if a.list_venues:
        for r in sorted(known.values(), key=lambda r: r["ord"]):
            print(r["slug"], r["name"], r["first_year"], r["note"] or "", sep="\t")
        return 0
    try:
        chosen = dims.select_venues(a.venues or list(known), known)
    except ValueError as unknown:
        print(unknown, file=sys.stderr)
        return 2
    cache = {} if a.no_cache else {k: v for k, v in (("cache", a.cache_dir), ("ttlDays", a.cache_ttl_days)) if v is not None}
    client = {"delay": a.delay, "maxDelay": a.max_delay, "retries": a.max_retries, "userAgent": a.user_agent, "timeout": a.timeout, "refresh": a.refresh} | cache | ({"opener": a.opener} if a.opener else {})
    http.register(spark)
    if a.debug:
        spark.sparkContext.setLogLevel("DEBUG")
    if a.index_pages:
        pages = spark.read.parquet(a.index_pages).where(F.col("venue").isin(chosen))
    else:
        urls = {a.index_url.replace("{}", known[v]["dblp_dir"]): v for v in chosen}
        venue_of = spark.createDataFrame(list(urls.items()), "url string, venue string")
        pages = cut(spark.read.format("lectern_urls").options(**client, urls=json.dumps(list(urls))).load(), "index").join(venue_of, "url")
    tocs = crawl.in_range(crawl.editions(pages, venues), a.since, a.until).orderBy(F.coalesce("year", F.lit(0)), "stem")
    queries = {f"toc:{r.toc_key}:": r for r in tocs.collect()}
    # the answers are written once, so that nothing is fetched again
    raw = cut(spark.read.format("lectern_pages").options(**client, url=a.url, queries=json.dumps(list(queries))).load(), "pages")
    dim = spark.createDataFrame([(q, r.venue, known[r.venue]["name"], r.toc_key, r.year) for q, r in queries.items()], "query string, venue string, venue_full string, toc_key string, toc_year int")
    papers = crawl.parse_hits(raw.where("body is not null").join(dim, "query"), a.include_editorship, a.include_front_matter)
    papers = crawl.in_range(papers, a.since, a.until)
    papers = cut(papers, "papers")
    files.write_formats(papers, a.out, "papers", tuple(a.formats), a.per_venue)
    if not a.quiet:
        for r in aggregates.crawl_summary(papers).orderBy(F.col("venue") == "TOTAL", "venue").collect():
            print(*("" if v is None else v for v in r), sep="\t")
        print(*(f"{k}={v}" for k, v in lookup.counters(raw).first().asDict().items()), file=sys.stderr)
    bad = crawl.status(raw).where("not complete").collect()
    for r in bad:
        print(f"incomplete: {r.query} {r.fetched}/{r.expected} {r.error or ''}", file=sys.stderr)
    return 1 if bad else 0


def run_enrich(spark: SparkSession, a: argparse.Namespace) -> int:
    papers = spark.read.parquet(a.papers)
    cache = ({"cache": a.cache_dir} if a.cache_dir and not a.no_cache else {}) | ({"opener": a.opener} if a.opener else {})
    if a.works:
        works = spark.read.parquet(a.works)
    elif a.url and a.answers:
        doi = F.lower("doi")
        works = lookup.works_of(lookup.fetch(spark, papers.where(~text.unsafe_doi(doi)).select(doi.alias("doi")), "doi", "doi", a.url, f"{a.answers}/doi", cache, mailto=a.mailto))
        if not a.no_title_match:
            todo = papers.where((F.coalesce("doi", F.lit("")) == "") | text.unsafe_doi(F.col("doi"))).select(text.search_query(F.col("title")).alias("q"))
            titled = lookup.works_of(lookup.fetch(spark, todo, "q", "title", a.url, f"{a.answers}/title", cache | {"delay": a.title_delay}, mailto=a.mailto))
            works = works.unionByName(titled)
    else:
        print("enrich needs --works, or --url and --answers", file=sys.stderr)
        return 2
    if a.preprints:
        preprints = spark.read.parquet(a.preprints)
    elif a.arxiv_url and a.answers and not a.no_arxiv:
        ids = works.select(text.arxiv_of_locations(F.col("locations")).alias("id"))
        preprints = lookup.entries_of(lookup.fetch(spark, ids, "id", "arxiv", a.arxiv_url, f"{a.answers}/arxiv", cache))
    else:
        preprints = spark.createDataFrame([], "id string, summary string")
    tables = [papers, works, preprints]
    found = enrich.enrich(*tables, limit=a.limit, title_match=not a.no_title_match, arxiv=not a.no_arxiv)
    files.write_atomic(found, a.out, "dblp_key")
    return 0


def run_analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    files.write_report(report.build(spark.read.parquet(a.papers), spark.read.parquet(a.venues_table)), a.out)
    return 0


def run_publish(spark: SparkSession, a: argparse.Namespace) -> int:
    papers = aggregates.labelled(spark.read.parquet(a.papers))
    compacted = report.compact(papers, spark.read.parquet(a.venues_table))
    files.write_shards(report.shards(compacted, files.read_jsonl_keyed(spark, a.abstracts)), a.shards)
    with open(a.report, encoding="utf-8") as f, open(a.template, encoding="utf-8") as t, open(a.out, "w", encoding="utf-8") as out:
        out.write(files.fill_template(t.read(), json.load(f)))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lectern").config("spark.speculation", "false").getOrCreate()
    return {"crawl": run_crawl, "enrich": run_enrich, "analyze": run_analyze, "publish": run_publish}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
