"""Works by DOI, by title and preprints by id, fetched in batches whose answers are kept, so that a run can go on later."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import windows
from lectern.sources import http

WORK = (
    "struct<results:array<struct<doi:string,display_name:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,"
    "locations:array<struct<landing_page_url:string,pdf_url:string>>>>>"
)
# Batch sizes, pauses and parameters of the three lookups.
KINDS = {
    "doi": {"size": 50, "delay": 0.15, "parameter": "filter", "template": "doi:{}", "separator": "|", "params": {"per-page": 50}},
    "title": {"size": 1, "delay": 1.0, "parameter": "filter", "template": "title.search:{}", "separator": "|", "params": {"per-page": 5}},
    "arxiv": {"size": 100, "delay": 3.0, "parameter": "id_list", "template": "{}", "separator": ",", "params": {"max_results": 100}},
}
SELECT = "doi,display_name,publication_year,abstract_inverted_index,locations"


def fetch(spark: SparkSession, wanted: DataFrame, column: str, kind: str, url: str, folder: str, options: dict | None = None, group: int = 20, mailto: str = "") -> DataFrame:
    """Answers ``items, body, error`` for the distinct values of ``column``; ``folder`` keeps them.

    Values that ``folder`` has answers for are not asked again; every ``group`` batches are written before the next are
    asked for, so a run that stops loses one group at most. Failed batches are asked again by the next run. What is left
    to ask for is a list of requests that a rate-limited server answers one by one, so it goes through the driver in
    groups.
    """
    how = KINDS[kind]
    http.register(spark)
    values = wanted.select(F.col(column).alias("v")).where("v <> ''").distinct()
    kept = kept_answers(spark, folder)
    if kept is not None:
        values = values.join(kept.where("error = ''").select(F.explode("items").alias("v")).distinct(), "v", "left_anti")
    params = how["params"] | ({"select": SELECT} if kind != "arxiv" else {}) | ({"mailto": mailto} if mailto else {})
    given = {"url": url, "delay": how["delay"], "parameter": how["parameter"], "template": how["template"], "separator": how["separator"], "params": json.dumps(params)} | (options or {})

    def ask(batches: list) -> None:
        answers = spark.read.format("lectern_lookup").options(**given, batches=json.dumps(batches)).load()
        answers.write.mode("append").parquet(folder)

    waiting = []
    for row in windows.batches(windows.ordinals(values, "v"), how["size"], "v").orderBy("batch").toLocalIterator():
        waiting.append(row["items"])
        if len(waiting) == group:
            ask(waiting)
            waiting = []
    if waiting:
        ask(waiting)
    answers = kept_answers(spark, folder)
    return answers if answers is not None else spark.createDataFrame([], f"items array<string>, body string, error string, {http.COUNTS}")


def kept_answers(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    schema = f"items array<string>, body string, error string, {http.COUNTS}"
    return spark.read.schema(schema).parquet(folder) if fs.exists(path) else None


def works_of(answers: DataFrame) -> DataFrame:
    """Works in the answers, numbered in order of arrival within their batch: later ones win over earlier ones."""
    found = answers.where("body is not null").select(F.posexplode(F.from_json("body", WORK)["results"]).alias("place", "w"), F.col("items")[0].alias("batch"))
    return windows.ordinals(found.select("batch", "place", "w.*"), "batch", "place", name="work_id").drop("batch", "place")


def entries_of(answers: DataFrame) -> DataFrame:
    """``id, summary`` of the Atom entries in the answers."""
    entry = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e")
    own = lambda tag: text.unescape_html(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return answers.where("body is not null").select(entry).select(own("id").alias("id"), own("summary").alias("summary"))


def counters(answers: DataFrame) -> DataFrame:
    """Requests, answers from the cache, retries and failures of a source's rows, in one row."""
    return answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "cached", "retries", "failed")])
