"""Abstracts for papers: by DOI, then longer preprint texts, then by title for what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import joins, merges


def enrich(papers: DataFrame, works: DataFrame, preprints: DataFrame, limit: int = 0, title_match: bool = True, arxiv: bool = True, pattern: str = text.ARXIV, doi_prefix: str = "https://doi.org/") -> DataFrame:
    """``dblp_key, abstract``. ``works`` has the inverted index and locations, ``preprints`` has ``id, summary``.

    ``limit`` keeps the first papers in order of arrival, for a trial run.
    """
    if limit:
        papers = papers.orderBy("row_idx").limit(limit)
    valid = text.clean_abstract(text.inverted_to_text(F.col("abstract_inverted_index")))
    by_doi = joins.texts_by_doi(papers, works, valid, text.arxiv_of_locations(F.col("locations"), pattern), doi_prefix)
    found = by_doi.select("dblp_key", "abstract").where("abstract is not null")
    if arxiv:
        ids = by_doi.select("dblp_key", "arxiv_id").where("arxiv_id is not null")
        entries = preprints.select(text.arxiv_of_url(F.col("id"), pattern).alias("arxiv_id"), text.clean_abstract(F.col("summary")).alias("abstract"))
        longer = ids.join(entries.where("arxiv_id <> '' and abstract is not null"), "arxiv_id").select("dblp_key", "abstract")
        longer = longer.groupBy("dblp_key").agg(F.max_by("abstract", F.struct(F.length("abstract"), "abstract")).alias("abstract"))
        found = merges.longer_wins(found, longer, "dblp_key", "abstract")
    if title_match:
        todo = merges.work_list(papers, found).where(text.search_query(F.col("title")).isNotNull())
        matched = joins.by_title_and_year(todo, works)
        titled = matched.select("dblp_key", valid.alias("abstract")).where("abstract is not null")
        found = found.join(titled.select("dblp_key"), "dblp_key", "left_anti").unionByName(titled)
    return found
