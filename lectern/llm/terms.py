"""How often every distinct term occurs, in how many records, and which terms are too rare or too common.

Defined results: a record with a NULL or empty text has no terms but counts as a record; a term that recurs in a
record counts each time as an occurrence and once as a record; an empty table has no terms. Rows are records; rows
that repeat a key are reduced to the valid one by ``valid_rows`` before. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = r"[a-z][a-z\-']{2,}"


def valid_rows(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """For each key the values of the row with the largest ``order``. Rows without a key are no records.

    ``max_by`` combines partially before the shuffle, so a key delivered very often costs one row per task.
    """
    newest = F.max_by(F.struct(*values), F.col(order)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *[F.col(f"_row.{v}").alias(v) for v in values])


def terms_of(text: Column, pattern: str = TERM) -> Column:
    """All matches of ``pattern`` in the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def term_counts(records: DataFrame, text: Column) -> DataFrame:
    """``term, occurrences, records``: one row per distinct term.

    Each record's terms are sorted in place and counted by runs, so a record emits a term once with its count. Both
    sums then come from one hash aggregate, which combines in each task before anything is shuffled: a term that holds a
    third of all rows sends one row per task.
    """
    ordered = records.select(F.array_sort(terms_of(text)).alias("_terms")).where(F.size("_terms") > 0)
    new = lambda i: (i == 0) | (F.get("_terms", i - 1) != F.get("_terms", i))
    runs = ordered.select("_terms", F.filter(F.sequence(F.lit(0), F.size("_terms") - 1), new).alias("_starts"))
    emitted = F.transform(
        "_starts", lambda i, k: F.struct(F.get("_terms", i).alias("term"), (F.coalesce(F.get("_starts", k + 1), F.size("_terms")) - i).alias("n"))
    )
    return (
        runs.select(F.explode(emitted).alias("_t"))
        .groupBy(F.col("_t.term").alias("term"))
        .agg(F.sum("_t.n").cast("bigint").alias("occurrences"), F.count("*").alias("records"))
    )


def mark_terms(counts: DataFrame, n_records: int, rare_at_most: int = 2, common_above: float = 0.05) -> DataFrame:
    """Adds ``mark``: ``rare`` for at most ``rare_at_most`` records, ``common`` for more than that share of all."""
    share = F.lit(float(common_above)) * F.lit(n_records)
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > share, "common")
    return counts.withColumn("mark", mark)
