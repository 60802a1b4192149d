"""File sources and sinks with pinned options: JSON lines, CSV, report JSON, shards, HTML, stored tables, SQLite."""

from __future__ import annotations

import csv
import json
import os
import sqlite3
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import aggregates

PAPERS = (
    "venue string, venue_full string, year int, title string, authors array<struct<name:string,raw_name:string,pid:string>>, pages string, doi string, "
    "ee string, dblp_key string, dblp_url string, toc_key string, type string, access string"
)
ABSTRACTS = "dblp_key string, abstract string"
# The columns of the flat form, in order.
FLAT = ["venue", "year", "title", "authors", "num_authors", "pages", "doi", "ee", "dblp_key", "dblp_url", "type", "access", "venue_full", "toc_key"]


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = PAPERS) -> DataFrame:
    """JSON lines; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_keyed(spark: SparkSession, path: str, schema: str = ABSTRACTS, key: str = "dblp_key") -> DataFrame:
    """JSON lines by key; the last line of a key wins; a missing file is an empty table.

    Lines are ordered by file name, block and place in the block: generated ids alone follow the order in which blocks
    are read, and large blocks are read first.
    """
    if not os.path.exists(path) and "://" not in path:
        return spark.createDataFrame([], schema)
    rows = read_jsonl(spark, path, schema).withColumns(
        {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    )
    return aggregates.last_wins(rows, [key], ["_file", "_block", "_at"]).drop("_file", "_block", "_at")


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``body``, with ``url`` from the file's name."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))


def read_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: ``id, summary``."""
    return spark.read.format("xml").option("rowTag", "entry").schema("id string, summary string").load(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def flat(papers: DataFrame) -> DataFrame:
    """One row per paper with the names joined, in the column order of the flat form."""
    names = F.array_join(F.transform("authors", lambda a: a["name"]), "; ")
    return papers.withColumn("num_authors", F.size("authors")).withColumn("authors", names).select(*FLAT)


CSV_OPTIONS = {"header": True, "escape": '"', "quote": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Empty strings stay empty strings; quoted fields may hold line breaks."""
    rows = spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=True).csv(path)
    return rows.na.fill("", [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)])


def write_csv_file(df: DataFrame, path: str) -> None:
    """One file with a byte-order mark and CRLF line ends. Rows stream through the driver one partition at a time."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])


def write_atomic(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in key order; the folder appears under its name only when it is whole.

    Works on any file system Spark knows. The old folder is moved aside first and deleted last, so at every moment
    one of the two is there.
    """
    tmp, old = (f"{path}.{uuid.uuid4().hex}" for _ in range(2))
    df.orderBy(*order).write.option("ignoreNullFields", "false").json(tmp)
    jvm = df.sparkSession._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(tmp), at(path)):
        raise OSError(f"{tmp} could not be moved to {path}")
    fs.delete(at(old), True)


def write_tables(tables: dict[str, DataFrame], folder: str, partition: dict[str, str] | None = None, replace_only_given: bool = True) -> None:
    """Stored tables as Parquet. A partitioned one replaces only the partitions that the new rows have."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if partition and name in partition:
            w = w.option("partitionOverwriteMode", "dynamic" if replace_only_given else "static").partitionBy(partition[name])
        w.parquet(f"{folder}/{name}")


def write_formats(papers: DataFrame, folder: str, stem: str, formats: tuple[str, ...] = ("jsonl", "csv"), per_venue: bool = False) -> None:
    """The papers in file order, in each format; ``per_venue`` adds one JSON-lines folder per venue in a single job."""
    ordered = papers.orderBy("venue", "year", "title", "dblp_key")
    if "jsonl" in formats:
        write_jsonl(ordered, f"{folder}/{stem}.jsonl")
    if "csv" in formats:
        write_csv_file(flat(ordered), f"{folder}/{stem}.csv")
    if "sqlite" in formats:
        write_sqlite(papers, f"{folder}/{stem}.db")
    if per_venue:
        ordered.write.mode("overwrite").partitionBy("venue").json(f"{folder}/by_venue")


def write_sqlite(papers: DataFrame, path: str, replace_venues: list[str] | None = None) -> None:
    """A SQLite file of three tables for local queries, in one transaction; rows stream through the driver.

    For tables too large for one file use ``write_tables``.
    """
    columns = ["dblp_key", "venue", "venue_full", "year", "title", "authors", "num_authors", "pages", "doi", "ee", "dblp_url", "type", "access", "toc_key"]
    rows = aggregates.last_wins(papers.where("dblp_key <> ''"), ["dblp_key"], ["row_idx"]) if "row_idx" in papers.columns else papers.where("dblp_key <> ''")
    with sqlite3.connect(path) as db:
        db.execute(f"create table if not exists papers (dblp_key text primary key, {', '.join(c + (' integer' if c in ('year', 'num_authors') else ' text') for c in columns[1:])})")
        db.execute("create table if not exists authors (pid text primary key, name text not null)")
        db.execute("create table if not exists paper_authors (dblp_key text, pid text, name text, position integer, primary key (dblp_key, position))")
        for name, table, on in (("venue_year", "papers", "venue, year"), ("name", "authors", "name"), ("pid", "paper_authors", "pid")):
            db.execute(f"create index if not exists by_{name} on {table} ({on})")
        for venue in replace_venues or []:
            db.execute("delete from paper_authors where dblp_key in (select dblp_key from papers where venue = ?)", (venue,))
            db.execute("delete from papers where venue = ?", (venue,))
        for r in rows.toLocalIterator():
            people = r["authors"] or []
            value = {"authors": "; ".join(a["name"] for a in people), "num_authors": len(people)}
            db.execute(f"insert or replace into papers values ({', '.join('?' * len(columns))})", [value.get(c, r[c] if c not in value else None) for c in columns])
            db.execute("delete from paper_authors where dblp_key = ?", (r["dblp_key"],))
            db.executemany("insert or replace into authors values (?, ?)", [(a["pid"], a["name"]) for a in people if a["pid"]])
            db.executemany("insert or replace into paper_authors values (?, ?, ?, ?)", [(r["dblp_key"], a["pid"], a["name"], i) for i, a in enumerate(people)])


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, separators=(",", ":"))


def write_shards(shards: DataFrame, folder: str) -> None:
    """One JSON array per shard, written by the executors: each file name is the shard's number."""
    rows = shards.select("shard", F.to_json("texts").alias("value"))
    rows.write.mode("overwrite").partitionBy("shard").text(folder)


def fill_template(template: str, report: dict, placeholder: str = "__SITE_DATA__") -> str:
    """The page with the report inlined so that it cannot close its element; a template without the placeholder is an error."""
    if placeholder not in template:
        raise ValueError(f"the template has no {placeholder}")
    return template.replace(placeholder, json.dumps(report, ensure_ascii=False, separators=(",", ":")).replace("<", "\\u003c"))
