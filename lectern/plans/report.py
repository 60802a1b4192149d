"""The analytics report, the compact form and its shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import aggregates, joins, windows
from lectern.session import cut


def occurrences(papers: DataFrame) -> DataFrame:
    """One row per paper and author occurrence."""
    return papers.select("row_idx", "venue", "year", F.posexplode("authors").alias("pos", "a")).select(
        "row_idx", "pos", F.col("a.pid").alias("pid"), F.col("a.name").alias("name"), "venue", "year"
    )


def compact(papers: DataFrame, venues: DataFrame) -> DataFrame:
    """Papers in browse order with venue, authors and topics as numbers.

    ``papers`` has ``labels`` and ``row_idx``; ``venues`` has ``slug, ord``. Author numbers follow first appearance.
    """
    people = occurrences(papers)
    numbers = windows.dictionary(people, "name", "row_idx", "pos", name="author_no")
    listed = F.array_sort(F.collect_list(F.struct("pos", "author_no")))
    by_paper = people.join(numbers, "name").groupBy("row_idx").agg(F.transform(listed, lambda x: x["author_no"]).alias("author_nos"))
    topics = aggregates.dims.topic_ids()
    topic_nos = F.transform("labels", lambda t: (F.array_position(F.array(*[F.lit(x) for x in topics]), t) - 1).cast("int"))
    rows = joins.with_dimension(papers, venues.select(F.col("slug").alias("venue"), F.col("ord").alias("vid")), "venue").join(by_paper, "row_idx", "left")
    rows = rows.select(
        "vid", "year", "title", F.coalesce("author_nos", F.array().cast("array<bigint>")).alias("author_nos"), "doi", "dblp_key", topic_nos.alias("topic_nos"), "row_idx"
    )
    return windows.ordinals(rows, F.desc("year"), "vid", "title", "dblp_key", "row_idx", name="browse_idx")


def shards(compacted: DataFrame, abstracts: DataFrame, size: int = 200) -> DataFrame:
    """``shard, texts``: the abstracts in browse order, ``""`` where there is none. A shard has at most ``size`` texts."""
    slots = windows.shard_slots(joins.with_abstracts(compacted, abstracts), "browse_idx", size)
    listed = F.array_sort(F.collect_list(F.struct("slot", "abstract")))
    return slots.groupBy("shard").agg(F.transform(listed, lambda x: x["abstract"]).alias("texts"))


def build(papers: DataFrame, venues: DataFrame, rules=None) -> dict:
    """The report as a document. Every part is an aggregate of bounded size but ``compact``, which is left to its sink.

    An empty table gives an empty report; a venue without papers is left out.
    """
    wide = papers.select("row_idx", "venue", "year", "title", "authors").repartition(papers.sparkSession.sparkContext.defaultParallelism)
    rows = cut(aggregates.labelled(wide, rules=rules), "labelled")  # tests of titles are dear, so all cores take part
    as_dicts = lambda df: [r.asDict(True) for r in df.collect()]
    nested: dict[str, dict] = {}
    for r in aggregates.count_by(rows, "venue", "year").orderBy("venue", "year").collect():
        nested.setdefault(r.venue, {})[str(r.year)] = r.n
    by_venue: dict[str, dict] = {}
    for r in aggregates.topic_counts(rows, "venue").orderBy("venue", "topic").collect():
        by_venue.setdefault(r.venue, {})[r.topic] = r.n
    bucketed = rows.withColumn("bucket", text.bucket(F.col("year"))).where("bucket is not null")
    by_bucket: dict[str, dict] = {}
    for r in aggregates.topic_counts(bucketed, "bucket").orderBy("bucket", "topic").collect():
        by_bucket.setdefault(r.bucket, {})[r.topic] = r.n
    trends = aggregates.term_trends(rows)
    dim = aggregates.topic_dim(papers.sparkSession, rules)
    names = {r.slug: r.name for r in venues.collect()}
    return {
        "meta": as_dicts(aggregates.overview(rows))[0],
        "venues": [r | {"name": names.get(r["venue"])} for r in as_dicts(aggregates.venue_summary(rows).orderBy("venue"))],
        "topics": as_dicts(aggregates.zero_filled(dim, aggregates.topic_counts(rows), "topic").orderBy("ord").drop("ord")),
        "per_venue_year": nested,
        "topic_by_venue": by_venue,
        "topic_by_bucket": by_bucket,
        "bucket_total": {r.bucket: r.n for r in aggregates.count_by(bucketed, "bucket").orderBy("bucket").collect()},
        "top_authors": as_dicts(aggregates.top_authors(aggregates.author_stats(occurrences(rows))).drop("author", "first_seen")),
        "rising": as_dicts(aggregates.rising(trends)),
        "declining": as_dicts(aggregates.declining(trends)),
    }
