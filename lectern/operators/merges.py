"""Set operations and merges: replace a scope, upsert, work lists, conditional merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import aggregates


def replace_scope(current: DataFrame, new: DataFrame, column: str, scope: list[str]) -> DataFrame:
    """Rows of the scope come from ``new`` only, all others stay."""
    keep = current.where(~F.coalesce(F.col(column).isin(scope), F.lit(False)))
    return keep.unionByName(new.where(F.col(column).isin(scope)))


def delete_children(children: DataFrame, parents: DataFrame, key: str, column: str, scope: list[str]) -> DataFrame:
    """Child rows whose parent is not in the scope."""
    return children.join(parents.where(F.col(column).isin(scope)).select(key).distinct(), key, "left_anti")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` replace those with an equal key; within ``new`` the last wins. Rows with an empty key are left out."""
    fresh = aggregates.last_wins(new.where(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")) != ""), keys, order)
    return current.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def upsert_papers(papers: DataFrame, authors: DataFrame, links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three stored tables after new papers: papers by key, authors by pid (never removed), links by key and position.

    ``new`` has the nested ``authors``; links of a paper are replaced as a whole.
    """
    fresh = aggregates.last_wins(new.where("dblp_key <> ''"), ["dblp_key"], ["row_idx"])
    flat = fresh.select("dblp_key", "row_idx", F.posexplode("authors").alias("position", "a"))
    new_links = flat.select("dblp_key", F.col("a.pid").alias("pid"), F.col("a.name").alias("name"), "position")
    seen = flat.where("a.pid <> ''").select(F.col("a.pid").alias("pid"), F.col("a.name").alias("name"), "row_idx", "position")
    new_authors = aggregates.last_wins(seen, ["pid"], ["row_idx", "position"]).select("pid", "name")
    keys = fresh.select("dblp_key")
    out_papers = papers.join(keys, "dblp_key", "left_anti").unionByName(fresh.select(*papers.columns))
    out_links = links.join(keys, "dblp_key", "left_anti").unionByName(new_links.select(*links.columns))
    out_authors = authors.join(new_authors, "pid", "left_anti").unionByName(new_authors)
    return out_papers, out_authors, out_links


def work_list(papers: DataFrame, done: DataFrame) -> DataFrame:
    """Papers left for the title search: without DOI, with an unsafe one, or without a result; each paper once."""
    from lectern.functions import text

    doi = F.coalesce("doi", F.lit(""))
    without = papers.where((doi == "") | text.unsafe_doi(doi))
    missed = papers.where(doi != "").join(done.select("dblp_key"), "dblp_key", "left_anti")
    return without.unionByName(missed.select(*papers.columns)).dropDuplicates(["dblp_key"])


def longer_wins(old: DataFrame, new: DataFrame, key: str, value: str, factor: float = 1.05) -> DataFrame:
    """All keys of either side: the new text where there was none, or where it is longer by more than the factor."""
    o, n = F.col("_old"), F.col("_new")
    joined = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key, "full")
    better = o.isNull() | (F.length(n) > F.length(o) * F.lit(factor).cast("double"))
    return joined.select(key, F.when(n.isNotNull() & better, n).otherwise(o).alias(value))


def pending(wanted: DataFrame, cache: DataFrame, key: str, newer_than=None) -> DataFrame:
    """Wanted keys that the cache lacks, or holds only from before ``newer_than``."""
    valid = cache if newer_than is None else cache.where(F.col("fetched_at") >= F.lit(newer_than))
    return wanted.join(valid.select(key).distinct(), key, "left_anti")
