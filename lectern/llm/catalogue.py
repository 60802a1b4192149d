"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import leakage, matching, packing, plainform, residue, subjects, terms, truncation
from lectern.session import cut, spread, table


def _title_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key: the title of its valid row, in plain form."""
    papers = table(spark, sf_dir, "papers")
    scores = plainform.fit_letter_pairs(papers.select("title"))
    valid = terms.valid_rows(papers, "dblp_key", "row_idx", "title")
    return valid.select("dblp_key", plainform.plain_form("title", scores).alias("title"))


def p1_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the titles with both counts and its mark."""
    papers = table(spark, sf_dir, "papers")
    n_records = papers.agg(F.count_distinct("dblp_key")).first()[0]
    counts = terms.term_counts(_title_records(spark, sf_dir), F.col("title"))
    return terms.mark_terms(counts, n_records)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common."""
    return p1_term_counts(spark, sf_dir).where("mark is not null").select("term", "mark")


def _plain_values(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    titles = table(spark, sf_dir, "papers").select("row_idx", F.col("title").alias("value"))
    names = table(spark, sf_dir, "paper_authors").select("row_idx", F.col("name").alias("value"))
    scores = plainform.fit_letter_pairs(titles.select("value"), names.select("value"))
    return [
        df.select(F.lit(field).alias("field"), "row_idx", "value", plainform.plain_form("value", scores).alias("plain"))
        for field, df in (("papers.title", titles), ("paper_authors.name", names))
    ]


def p2_plain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and name with its plain form."""
    titles, names = _plain_values(spark, sf_dir)
    return titles.unionByName(names)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value is not in plain form."""
    return p2_plain_values(spark, sf_dir).where("value <> plain").select("field", "row_idx")


def _abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "abstracts").select("abstract_id", "dblp_key", "source", "abstract"))


def p3_cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every abstract without residue, with the verdict on its ending. Rows with residue are no texts that could be cut."""
    abstracts = _abstracts(spark, sf_dir)
    kept = residue.without_residue(abstracts, "abstract", residue.fit_residue_index(abstracts, "abstract"))
    kept = cut(kept, "kept", lean=True)
    return truncation.mark_cut(kept, "abstract_id", "source", "abstract", spent=kept)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts cut in mid-word or mid-sentence."""
    return p3_cut_texts(spark, sf_dir).where("is_cut").select("abstract_id")


def p3_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates. The share is of all rows of the source."""
    marked = p3_cut_texts(spark, sf_dir)
    all_rows = table(spark, sf_dir, "abstracts").select("abstract_id", "source")
    full = all_rows.join(marked.select("abstract_id", "is_cut"), "abstract_id", "left").withColumn("is_cut", F.coalesce("is_cut", F.lit(False)))
    return truncation.share_by_source(full, "source")


def p4_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts that hold residue, with the best exemplar."""
    abstracts = _abstracts(spark, sf_dir)
    found = residue.residue_rows(abstracts, "abstract", residue.fit_residue_index(abstracts, "abstract"))
    return found.select("abstract_id", "source", "residue.label", "residue.exemplar", "residue.score")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts that hold residue."""
    return p4_residue(spark, sf_dir).select("abstract_id")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the same publication in papers (valid row per key) and works, with a confidence."""
    papers = table(spark, sf_dir, "papers")
    works = table(spark, sf_dir, "works").select("work_id", "display_name", "publication_year", "doi")
    scores = plainform.fit_letter_pairs(papers.select("title"), works.select("display_name"))
    valid = terms.valid_rows(papers, "dblp_key", "row_idx", "title", "year", "doi")
    left = valid.withColumn("title", plainform.plain_form("title", scores))
    right = works.withColumn("display_name", plainform.plain_form("display_name", scores))
    found = matching.best_matches(left, right, ("dblp_key", "title", "year", "doi"), ("work_id", "display_name", "publication_year", "doi"))
    return found.select(
        F.col("left_id").alias("dblp_key"), F.col("right_id").cast("bigint").alias("work_id"), "confidence"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the same publication."""
    return p5_matches(spark, sf_dir).select("dblp_key", "work_id")


#: Rank file of a public byte-level BPE; a path, so that another tokenizer can be named.
TOKENIZER = os.environ.get("LECTERN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document (or piece of one) for each capacity."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = packing.count_tokens(docs, "doc_id", "text", TOKENIZER)
    return packing.pack(sizes, "doc_id", "tokens", table(spark, sf_dir, "pack_sizes"), "pack_id", "capacity_tokens")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and room left for each capacity."""
    return packing.fill_report(p6_packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"), "pack_id", "capacity_tokens")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry sentences of evaluation passages, with the number of sentences and the best coverage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leakage.find_leaks(docs, "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they carry."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item that leaked, with the number of documents that carry it."""
    return p7_leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("sentences").alias("most_sentences"))


def p8_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of every document, with the number of sentences on each."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    areas = [r.topic_id for r in table(spark, sf_dir, "topics").orderBy("ord").collect()]
    model = subjects.fit_areas(docs, "doc_id", "text", table(spark, sf_dir, "topic_labels"), "topic_id", areas)
    return subjects.areas_of(docs, "doc_id", "text", model).withColumnRenamed("area", "topic_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of every document."""
    return p8_areas(spark, sf_dir).select("doc_id", "topic_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each subject area in the corpus."""
    n = table(spark, sf_dir, "documents").count()
    counts = p8_areas(spark, sf_dir).groupBy("topic_id").agg(F.count("*").alias("documents"))
    return counts.withColumn("share", F.col("documents") / F.lit(max(n, 1)))


def queries() -> dict:
    return {f.__name__: f for f in (p1_term_counts, p1_found, p2_plain_values, p2_found, p3_cut_texts, p3_found, p3_share_by_source, p4_residue, p4_found, p5_matches, p5_found, p6_packed, p6_fill, p7_leaks, p7_found, p7_leaked_items, p8_areas, p8_found, p8_shares)}


def oracle_sql() -> dict:
    return {}
