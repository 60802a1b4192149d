"""Joins of papers with works, preprints, abstracts and dimensions. Catalyst picks the strategy from sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import dims, text
from lectern.operators import aggregates, windows


def by_doi(papers: DataFrame, works: DataFrame, paper_order: str = "row_idx", work_order: str = "work_id", prefix: str = "https://doi.org/") -> DataFrame:
    """Papers with the last work of an equal DOI; of papers with one DOI the last is kept. Unsafe DOIs take no part."""
    doi = F.lower("doi")
    left = aggregates.last_wins(papers.where((F.col("doi") != "") & ~text.unsafe_doi(F.col("doi"))).withColumn("_doi", doi), ["_doi"], [paper_order])
    right = aggregates.last_wins(works.withColumn("_doi", text.bare_doi(F.col("doi"), prefix)).where("_doi <> ''").drop("doi"), ["_doi"], [work_order])
    return left.join(right, "_doi").drop("_doi")


def by_title_and_year(papers: DataFrame, works: DataFrame, rank: str = "work_id", apart: int = 1) -> DataFrame:
    """For each paper the first work, by rank, with an equal normalised title and a year at most ``apart`` away.

    A work without a year passes; an empty normalised title matches nothing. The equal title is the join key, so the
    year band is a residual condition and no pairs are made beyond equal titles.
    """
    left = papers.withColumn("_t", text.norm_title(F.col("title"))).where("_t <> ''")
    right = works.withColumn("_t", text.norm_title(F.col("display_name"))).where("_t <> ''").drop("doi")
    y = F.col("publication_year")
    near = y.isNull() | (y == 0) | (F.abs(y - F.col("year")) <= apart)
    return windows.first_choice(left.join(right, "_t").where(near).drop("_t"), ["dblp_key"], rank)


def texts_by_doi(papers: DataFrame, works: DataFrame, text_of, id_of, prefix: str = "https://doi.org/") -> DataFrame:
    """``dblp_key, abstract, arxiv_id`` by DOI. Text and id are chosen apart, each from the last work that has one.

    So a later work without a valid text leaves the text of an earlier one in place. Of papers with one DOI the last is
    kept; unsafe DOIs take no part. ``text_of`` and ``id_of`` are columns of ``works``, NULL where there is none.
    """
    left = papers.where((F.col("doi") != "") & ~text.unsafe_doi(F.col("doi"))).groupBy(F.lower("doi").alias("_doi")).agg(F.max_by("dblp_key", "row_idx").alias("dblp_key"))
    right = works.select(text.bare_doi(F.col("doi"), prefix).alias("_doi"), "work_id", text_of.alias("abstract"), id_of.alias("arxiv_id")).where("_doi <> ''")
    right = right.groupBy("_doi").agg(
        F.expr("max_by(abstract, work_id) filter (where abstract is not null)").alias("abstract"), F.expr("max_by(arxiv_id, work_id) filter (where arxiv_id is not null)").alias("arxiv_id")
    )
    return left.join(right, "_doi").drop("_doi")


def with_abstracts(papers: DataFrame, abstracts: DataFrame) -> DataFrame:
    """All papers, with the abstract or ``""``, and whether there is one."""
    joined = papers.join(abstracts, "dblp_key", "left").withColumn("abstract", F.coalesce("abstract", F.lit("")))
    return joined.withColumn("has_abs", (F.col("abstract") != "").cast("int"))


def with_dimension(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Join with a dimension in which every key must be found; an unknown key is an error of the job that meets it."""
    joined = df.join(dim.withColumn("_found", F.lit(True)), key, "left")
    said = F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    return joined.where(F.when(F.col("_found"), True).otherwise(F.raise_error(said).cast("boolean"))).drop("_found")


def rule_matches(df: DataFrame, title: str, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """Each row with each rule it matches. The list of rules is a parameter, so it goes into the row, not into a join.

    Rows that have ``labels`` already are not tested again.
    """
    labels = F.col("labels") if "labels" in df.columns else text.classify(F.col(title), rules)
    return df.withColumn("topic", F.explode(labels)).where(F.col("topic") != dims.OTHER)


def authored_in(papers: DataFrame, paper_authors: DataFrame, name: str) -> DataFrame:
    """Papers per venue of one author."""
    return papers.join(paper_authors.where(F.col("name") == name).select("dblp_key"), "dblp_key").groupBy("venue").agg(F.count("*").alias("n"))
