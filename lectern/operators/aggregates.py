"""Aggregations of the analytics report. Every function takes column roles, so it runs on any table of that shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dims, text


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per combination of keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def labelled(df: DataFrame, title: str = "title", rules=None) -> DataFrame:
    """Adds ``labels``; one projection, so each title is tested once against every rule."""
    return df.withColumn("labels", text.classify(F.col(title), rules))


def topic_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per label and keys. A row with several labels counts under each, so sums exceed the total."""
    return df.select(*keys, F.explode("labels").alias("topic")).groupBy(*keys, "topic").agg(F.count("*").alias("n"))


def topic_dim(spark, rules=None) -> DataFrame:
    rows = [(i, t, zh, en) for i, (t, zh, en, _) in enumerate(dims.topic_rules(rules))]
    rows.append((len(rows), dims.OTHER, *dims.OTHER_NAMES))
    return spark.createDataFrame(rows, "ord int, topic string, zh string, en string")


def zero_filled(dim: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """All rows of the dimension, with 0 where nothing was counted."""
    return dim.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def author_key(pid: Column, name: Column) -> Column:
    return text.or_else(pid, name)


def author_stats(occurrences: DataFrame) -> DataFrame:
    """Per author key: rows, display name, year span and venues.

    ``occurrences`` has ``row_idx, pos, pid, name, venue, year``. The name is the last one seen; venues are ordered by
    rows, then by first appearance. Two aggregations on prefixes of one key share their shuffle.
    """
    keyed = occurrences.select(author_key(F.col("pid"), F.col("name")).alias("author"), "name", "venue", "year", F.struct("row_idx", "pos").alias("at"))
    per_venue = keyed.groupBy("author", "venue").agg(
        F.count("*").alias("n"), F.max_by("name", "at").alias("name"), F.min("at").alias("first"), F.max("at").alias("last"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "first", "venue")))
    return per_venue.groupBy("author").agg(
        F.max_by("name", "last").alias("name"), F.sum("n").alias("n"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"),
        F.transform(ordered, lambda v: F.struct(v["venue"].alias("venue"), (-v["minus"]).alias("n"))).alias("venues"), F.min("first").alias("first_seen"),
    )


def top_authors(stats: DataFrame, k: int = 60) -> DataFrame:
    """The ``k`` authors with most rows; ties by first appearance."""
    return stats.orderBy(F.desc("n"), "first_seen").limit(k)


def term_trends(
    df: DataFrame,
    title: str = "title",
    year: str = "year",
    recent: tuple[int, int] = (2014, 2026),
    past: tuple[int, int] = (1995, 2013),
    support: int = 25,
    smoothing: float = 0.3,
    scale: float = 1000.0,
) -> DataFrame:
    """Rates of title terms in two year windows and their smoothed ratio, for terms in ``support`` recent titles or more.

    A title counts once per term. Window sizes count every row of the window, also those without terms; they come from
    one small aggregate, which every task gets as a scalar.
    """
    window = F.when(F.col(year).between(*recent), "r").when(F.col(year).between(*past), "p")
    rows = df.select(F.array_distinct(text.title_terms(F.col(title))).alias("terms"), window.alias("w")).where("w is not null")
    sizes = rows.agg(F.count_if(F.col("w") == "r").alias("r"), F.count_if(F.col("w") == "p").alias("p")).first()
    counts = rows.select(F.explode("terms").alias("term"), "w").groupBy("term").agg(
        F.count_if(F.col("w") == "r").alias("recent"), F.count_if(F.col("w") == "p").alias("past")
    )
    r_rate = F.col("recent") / F.lit(float(max(sizes.r, 1))) * scale
    p_rate = F.col("past") / F.lit(float(max(sizes.p, 1))) * scale
    return counts.where(F.col("recent") >= support).select(
        "term", "recent", "past", F.bround(r_rate, 2).alias("recent_rate"), F.bround(p_rate, 2).alias("past_rate"),
        F.bround((r_rate + smoothing) / (p_rate + smoothing), 2).alias("ratio"),
    )


def rising(trends: DataFrame, k: int = 28) -> DataFrame:
    return trends.orderBy(F.desc("ratio"), "term").limit(k)


def declining(trends: DataFrame, k: int = 28, support: int = 25) -> DataFrame:
    return trends.where(F.col("past") >= support).orderBy("ratio", "term").limit(k)


def overview(papers: DataFrame) -> DataFrame:
    """One row: rows, editions, author names, year span, share of labelled rows and mean number of labels."""
    names = papers.select(F.explode("authors.name").alias("name")).agg(F.count_distinct("name").alias("authors"))
    is_other = F.array_contains("labels", dims.OTHER)
    main = papers.agg(
        F.count("*").alias("total"),
        F.count_distinct(F.struct("venue", "year")).alias("editions"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.bround(1 - F.try_divide(F.count_if(is_other), F.count("*")), 4).alias("coverage"),
        F.bround(F.avg(F.size("labels")), 2).alias("avg_labels"),
    )
    both = main.unionByName(names, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def venue_summary(papers: DataFrame) -> DataFrame:
    """Rows, sorted years, first and last year per venue."""
    return papers.groupBy("venue").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("year")).alias("years"), F.min("year").alias("first"), F.max("year").alias("last")
    )


def crawl_summary(papers: DataFrame) -> DataFrame:
    """Rows, editions and span per venue, and a last line with the number of rows only."""
    rolled = papers.rollup("venue").agg(
        F.count("*").alias("n"), F.count_distinct("year").alias("editions"), F.min("year").alias("first"), F.max("year").alias("last"), F.grouping("venue").alias("_all")
    )
    only = lambda c: F.when(F.col("_all") == 0, F.col(c)).alias(c)
    return rolled.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("venue")).alias("venue"), "n", only("editions"), only("first"), only("last"))


def last_wins(df: DataFrame, keys: list[str], order: list[str], unique: bool = False) -> DataFrame:
    """One row per key, the one last in ``order``; keys that are NULL are one key.

    With ``unique``, ``order`` is one column whose values no two rows share: the largest of each key comes from a hash
    aggregate over two columns, and only the columns that are used later are read for the rows themselves. These are
    shuffled by key and order, so a key that holds a third of all rows is spread. Without, ``max_by`` keeps one row per
    key and task before the shuffle.
    """
    if unique:
        (last,) = order
        names = [f"_k{i}" for i in range(len(keys))]
        newest = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.max(last).alias("_last"))
        same = F.col(last) == F.col("_last")
        for k, n in zip(keys, names, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(n))
        return df.join(newest.hint("shuffle_hash"), same, "left_semi")
    whole = F.struct(*[F.col(c) for c in df.columns])
    kept = df.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row"))
    return kept.select("_row.*")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def ordered_concat(df: DataFrame, keys: list[str], order: str, value: str, separator: str = "; ") -> DataFrame:
    """Values of each group joined in order. A group becomes one string, so groups must be of bounded size."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x[value]), separator).alias("joined"))


def text_stats(df: DataFrame, column: str) -> DataFrame:
    """Texts that are not empty, their characters and their share of all rows."""
    full = F.coalesce(F.col(column), F.lit("")) != ""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(full).alias("n_texts"),
        F.coalesce(F.sum(F.length(column)), F.lit(0)).cast("bigint").alias("characters"),
        F.when(F.count("*") > 0, F.bround(F.count_if(full) / F.count("*"), 4)).alias("hit_rate"),
    )


def edition_status(expected: DataFrame, fetched: DataFrame, key: str = "toc_key") -> DataFrame:
    """For each edition the rows expected and fetched and whether it is complete."""
    got = fetched.groupBy(key).agg(F.count("*").alias("fetched"))
    joined = expected.join(got, key, "left").withColumn("fetched", F.coalesce("fetched", F.lit(0).cast("bigint")))
    return joined.withColumn("complete", F.col("fetched") >= F.col("expected"))
