"""Queries over the test tables, by operator, and their DuckDB forms.

Each pair is kept together: the query first, its SQL under the same name. Lists become strings in both, so that their
values can be compared.
"""

from __future__ import annotations

import functools
import json
import os
import sqlite3
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dims, text
from lectern.operators import aggregates, joins, merges, windows
from lectern.plans import crawl, enrich, report
from lectern.session import register_views, scratch_dir, spread, table
from lectern.sources import files, http, lookup
from lectern.streaming import refresh

ARXIV_TEST = r"(?i)arxiv\.example/(?:abs|pdf)/([a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})"
QUERIES: dict = {}
SQL: dict[str, str] = {}
VALID = "(select * from papers qualify row_number() over (partition by dblp_key order by row_idx desc) = 1)"
TERMS = (
    "list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z\\-'']{2,}'), "
    f"lambda w: w not in ({', '.join(repr(w) for w in sorted(set(dims.STOPWORDS)))})))"
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def papers_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers")


def valid_of(spark: SparkSession, d: str) -> DataFrame:
    """Papers with the last delivery of each key."""
    return aggregates.last_wins(papers_of(spark, d), ["dblp_key"], ["row_idx"], unique=True)


def _sql_labels(title: str, source: str) -> str:
    """The rules in SQL. The one rule with a look-ahead counts its matches with and without what must not follow."""
    t = f"regexp_replace(lower(coalesce({title}, '')), '[\\x{{aa}}\\x{{b2}}\\x{{b3}}\\x{{b5}}\\x{{b9}}\\x{{ba}}\\x{{c0}}-\\x{{2c1}}\\x{{370}}-\\x{{1fff}}\\x{{2c00}}-\\x{{2fff}}\\x{{3040}}-\\x{{d7ff}}\\x{{f900}}-\\x{{fdff}}\\x{{ff10}}-\\x{{ff19}}\\x{{ff21}}-\\x{{ff3a}}\\x{{ff41}}-\\x{{ff5a}}]', '0', 'g')"
    out = []
    for topic, _, _, pattern in dims.topic_rules():
        quoted = pattern.replace("'", "''")
        if "(?!" in pattern:
            bare = quoted.replace(r"|\bpolynomial(s)?\b(?!\s+time)", "")
            test = (
                f"(regexp_matches(t, '{bare}') or len(regexp_extract_all(t, '\\bpolynomials?\\b')) > len(regexp_extract_all(t, '\\bpolynomials?\\b\\s+time')))"
            )
        else:
            test = f"regexp_matches(t, '{quoted}')"
        out.append(f"case when {test} then '{topic}' end")
    hits = f"list_filter([{', '.join(out)}], lambda x: x is not null)"
    return f"(select *, case when len(hits) > 0 then hits else ['other'] end as labels from (select *, {hits} as hits from (select *, {t} as t from {source})))"


LABELLED = _sql_labels("title", VALID)
BUCKET = "cast(year - ((year % 5) + 5) % 5 as varchar) || '-' || cast(year - ((year % 5) + 5) % 5 + 4 as varchar)"


def labelled_of(spark: SparkSession, d: str) -> DataFrame:
    """Valid papers with labels. Titles are labelled as they are scanned, where all cores take part, then reduced."""
    columns = ["dblp_key", "row_idx", "venue", "year", "title", "authors", "doi"]
    # by max_by: a semi-join would be moved below the labels, which would then be made by the few tasks after a shuffle
    return aggregates.last_wins(aggregates.labelled(spread(papers_of(spark, d).select(*columns))), ["dblp_key"], ["row_idx"])


# --- aggregates -----------------------------------------------------------------------------------------------------


@query(f"select venue, year, count(*) as n from {VALID} group by all")
def count_by_venue_year(spark, d):
    return aggregates.count_by(valid_of(spark, d), "venue", "year")


@query(f"select row_idx, array_to_string(labels, ',') as labels from {_sql_labels('title', 'papers')}")
def topic_labels_of_titles(spark, d):
    return aggregates.labelled(spread(papers_of(spark, d).select("row_idx", "title"))).select("row_idx", F.array_join("labels", ",").alias("labels"))


@query(
    "with c as (select unnest(labels) as topic, count(*) as n from " + LABELLED + " group by 1), dim as (select * from (values "
    + ", ".join(f"({i}, '{t}', '{en}')" for i, (t, _, en, _) in enumerate([*dims.TOPIC_RULES, (dims.OTHER, "", dims.OTHER_NAMES[1], "")]))
    + ") v(ord, topic, en)) select cast(ord as integer) as ord, dim.topic, en, coalesce(n, 0) as n from dim left join c on c.topic = dim.topic"
)
def topic_counts(spark, d):
    counts = aggregates.topic_counts(labelled_of(spark, d))
    return aggregates.zero_filled(aggregates.topic_dim(spark), counts, "topic").select("ord", "topic", "en", "n")


@query(f"select venue, topic, count(*) as n from (select venue, unnest(labels) as topic from {LABELLED}) group by all")
def topic_by_venue(spark, d):
    return aggregates.topic_counts(labelled_of(spark, d), "venue")


@query(f"select bucket, topic, count(*) as n from (select {BUCKET} as bucket, unnest(labels) as topic from {LABELLED}) group by all")
def topic_by_bucket(spark, d):
    return aggregates.topic_counts(labelled_of(spark, d).withColumn("bucket", text.bucket(F.col("year"))), "bucket")


@query(f"select {BUCKET} as bucket, count(*) as n from {VALID} group by 1")
def bucket_total(spark, d):
    return aggregates.count_by(valid_of(spark, d).withColumn("bucket", text.bucket(F.col("year"))), "bucket")


_AUTHORS = f"""
with o as (select row_idx, unnest(range(len(authors))) as pos, unnest(authors, recursive := false) as a, venue, year from {VALID}),
k as (select coalesce(nullif(a.pid, ''), a.name) as author, a.name as name, venue, year, row_idx * 100000 + pos as spot from o),
v as (select author, venue, count(*) as n, min(spot) as first, arg_max(name, spot) as name, max(spot) as last, min(year) as fy, max(year) as ly from k group by all)
"""


@query(
    _AUTHORS + "select author, arg_max(name, last) as name, cast(sum(n) as bigint) as n, min(fy) as first_year, max(ly) as last_year, "
    "string_agg(venue || ':' || n, ',' order by n desc, first) as venues from v group by author"
)
def author_stats(spark, d):
    stats = aggregates.author_stats(report.occurrences(valid_of(spark, d)))
    shown = F.array_join(F.transform("venues", lambda v: F.concat(v["venue"], F.lit(":"), v["n"].cast("string"))), ",")
    return stats.select("author", "name", "n", "first_year", "last_year", shown.alias("venues"))


@query(
    _AUTHORS + "select author, arg_max(name, last) as name, cast(sum(n) as bigint) as n from v group by author order by sum(n) desc, min(first) limit 60"
)
def top_authors(spark, d):
    return aggregates.top_authors(aggregates.author_stats(report.occurrences(valid_of(spark, d)))).select("author", "name", "n")


_TRENDS = f"""
with p as (select {TERMS} as terms, case when year between 2014 and 2026 then 'r' when year between 1995 and 2013 then 'p' end as w from {VALID}),
s as (select count(*) filter (w = 'r') as nr, count(*) filter (w = 'p') as np from p),
c as (select term, count(*) filter (w = 'r') as recent, count(*) filter (w = 'p') as past from (select unnest(terms) as term, w from p where w is not null) group by 1),
q as (select *, recent / cast(nr as double) * 1000.0 as rr, past / cast(greatest(np, 1) as double) * 1000.0 as pr from c, s where recent >= 25),
t as (select term, recent, past, round_even(rr, 2) as recent_rate, round_even(pr, 2) as past_rate, round_even((rr + 0.3) / (pr + 0.3), 2) as ratio from q)
"""


@query(_TRENDS + "select * from t")
def term_trends(spark, d):
    return aggregates.term_trends(valid_of(spark, d))


@query(_TRENDS + "select * from t order by ratio desc, term limit 28")
def rising_terms(spark, d):
    return aggregates.rising(aggregates.term_trends(valid_of(spark, d)))


@query(_TRENDS + "select * from t where past >= 25 order by ratio, term limit 28")
def declining_terms(spark, d):
    return aggregates.declining(aggregates.term_trends(valid_of(spark, d)))


@query(
    f"select count(*) as total, count(distinct (venue, year)) as editions, min(year) as year_min, max(year) as year_max, "
    f"round_even(1 - count(*) filter (list_contains(labels, 'other')) / count(*), 4) as coverage, round_even(avg(len(labels)), 2) as avg_labels, "
    f"(select count(distinct a.name) from (select unnest(authors) as a from {VALID})) as authors from {LABELLED}"
)
def overview(spark, d):
    return aggregates.overview(labelled_of(spark, d))


@query(
    f"select venue, count(*) as n, array_to_string(list_sort(list(distinct year) filter (year is not null)), ',') as years, min(year) as first, max(year) as last from {VALID} group by venue"
)
def venue_summary(spark, d):
    return aggregates.venue_summary(valid_of(spark, d)).withColumn("years", F.array_join("years", ","))


@query(
    f"with v as {VALID} select venue, count(*) as n, count(distinct year) as editions, min(year) as first, max(year) as last from v group by venue "
    "union all select 'TOTAL', count(*), null, null, null from v"
)
def crawl_summary(spark, d):
    return aggregates.crawl_summary(valid_of(spark, d))


@query(f"select dblp_key, row_idx, title, year, doi from {VALID}")
def last_wins(spark, d):
    return valid_of(spark, d).select("dblp_key", "row_idx", "title", "year", "doi")


@query("select dblp_key, position, min(row_idx) as row_idx, arg_min(name, row_idx) as name from paper_authors group by all")
def first_wins(spark, d):
    return aggregates.first_wins(table(spark, d, "paper_authors").select("dblp_key", "position", "row_idx", "name"), ["dblp_key", "position"], ["row_idx"]).select("dblp_key", "position", "row_idx", "name")


@query("select row_idx // 64 as paper, string_agg(name, '; ' order by row_idx) as joined from paper_authors group by 1")
def names_joined(spark, d):
    rows = table(spark, d, "paper_authors").withColumn("paper", F.floor(F.col("row_idx") / 64))
    return aggregates.ordered_concat(rows, ["paper"], "row_idx", "name")


@query(
    "select source, count(*) as n_rows, count(*) filter (coalesce(abstract, '') <> '') as n_texts, cast(coalesce(sum(length(abstract)), 0) as bigint) as characters, "
    "round_even(count(*) filter (coalesce(abstract, '') <> '') / count(*), 4) as hit_rate from abstracts group by source"
)
def abstract_stats(spark, d):
    a = table(spark, d, "abstracts")
    full = F.coalesce("abstract", F.lit("")) != ""
    return a.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count_if(full).alias("n_texts"), F.coalesce(F.sum(F.length("abstract")), F.lit(0)).cast("bigint").alias("characters"),
        F.bround(F.count_if(full) / F.count("*"), 4).alias("hit_rate"),
    )


@query("select pid, arg_max(name, row_idx) as name, count(*) as n from paper_authors group by pid order by n desc, pid limit 20")
def busiest_pids(spark, d):
    pa = table(spark, d, "paper_authors")
    return pa.groupBy("pid").agg(F.max_by("name", "row_idx").alias("name"), F.count("*").alias("n")).orderBy(F.desc("n"), "pid").limit(20)


@query("select toc_key, count(*) as expected, count(*) filter (type <> 'Editorship') as fetched, count(*) = count(*) filter (type <> 'Editorship') as complete from papers where toc_key is not null group by toc_key")
def edition_status(spark, d):
    p = papers_of(spark, d)
    expected = p.groupBy("toc_key").agg(F.count("*").alias("expected"))
    return aggregates.edition_status(expected, p.where("type <> 'Editorship'")).where("toc_key is not null")


# --- joins ----------------------------------------------------------------------------------------------------------

@query(
    f"with p as (select * from {VALID} where doi <> '' and not contains(doi, '|') and not contains(doi, ',') qualify row_number() over (partition by lower(doi) order by row_idx desc) = 1), "
    "w as (select *, lower(replace(coalesce(doi, ''), 'https://doi.example/', '')) as k from works where k <> '' qualify row_number() over (partition by k order by work_id desc) = 1) "
    "select dblp_key, work_id from p join w on lower(p.doi) = w.k"
)
def doi_join(spark, d):
    return joins.by_doi(valid_of(spark, d), table(spark, d, "works"), prefix="https://doi.example/").select("dblp_key", "work_id")


@query(
    f"with p as (select dblp_key, year, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as t from {VALID}), "
    "w as (select work_id, publication_year as y, regexp_replace(lower(display_name), '[^a-z0-9]+', '', 'g') as t from works) "
    "select dblp_key, min(work_id) as work_id from p join w using (t) where t <> '' and (y is null or y = 0 or abs(y - year) <= 1) group by dblp_key"
)
def title_year_join(spark, d):
    return joins.by_title_and_year(valid_of(spark, d), table(spark, d, "works")).select("dblp_key", "work_id")


@query(
    "with a as (select dblp_key, arg_max(abstract, abstract_id) as abstract from abstracts where coalesce(abstract, '') <> '' group by 1) "
    f"select p.dblp_key, coalesce(a.abstract, '') as abstract, cast(a.abstract is not null as integer) as has_abs from {VALID} p left join a using (dblp_key)"
)
def papers_with_abstracts(spark, d):
    a = table(spark, d, "abstracts").where("coalesce(abstract, '') <> ''")
    last = aggregates.last_wins(a, ["dblp_key"], ["abstract_id"], unique=True).select("dblp_key", "abstract")
    return joins.with_abstracts(valid_of(spark, d).select("dblp_key"), last)


@query(f"select dblp_key from {VALID} p where not exists (select 1 from abstracts a where a.dblp_key = p.dblp_key)")
def papers_without_abstracts(spark, d):
    return valid_of(spark, d).select("dblp_key").join(table(spark, d, "abstracts"), "dblp_key", "left_anti")


@query(f"select p.dblp_key, v.ord, v.name from {VALID} p join venues v on v.slug = p.venue")
def venue_dimension(spark, d):
    dim = table(spark, d, "venues").select(F.col("slug").alias("venue"), "ord", "name")
    return joins.with_dimension(valid_of(spark, d).select("dblp_key", "venue"), dim, "venue").select("dblp_key", "ord", "name")


@query(f"select venue, count(*) as n from {VALID} p join (select dblp_key from paper_authors where name = 'Lowland Problem Collective') using (dblp_key) group by venue")
def join_filter_group(spark, d):
    return joins.authored_in(valid_of(spark, d), table(spark, d, "paper_authors"), "Lowland Problem Collective")


@query(f"select dblp_key, topic from (select dblp_key, unnest(labels) as topic from {LABELLED}) where topic <> 'other'")
def rule_matches(spark, d):
    return joins.rule_matches(labelled_of(spark, d), "title", dims.TOPIC_RULES).select("dblp_key", "topic")


@query(
    "select arxiv_id, string_agg(cast(work_id as varchar), ',' order by work_id) as works from (select work_id, regexp_extract(list_filter(flatten(list_transform(locations, lambda l: "
    "[l.landing_page_url, l.pdf_url])), lambda u: regexp_matches(u, '(?i)arxiv\\.example/(abs|pdf)/([a-z-]+(\\.[A-Z]{2})?/\\d{7}|\\d{4}\\.\\d{4,5})'))[1], "
    "'(?i)arxiv\\.example/(?:abs|pdf)/([a-z-]+(?:\\.[A-Z]{2})?/\\d{7}|\\d{4}\\.\\d{4,5})', 1) as arxiv_id from works) where arxiv_id <> '' group by 1"
)
def works_by_arxiv_id(spark, d):
    ids = table(spark, d, "works").select("work_id", text.arxiv_of_locations(F.col("locations"), ARXIV_TEST).alias("arxiv_id")).where("arxiv_id is not null")
    return ids.groupBy("arxiv_id").agg(F.array_join(F.sort_array(F.collect_list("work_id")), ",").alias("works"))


# --- merges ---------------------------------------------------------------------------------------------------------

_SOURCE = "(select dblp_key, arg_max(abstract, abstract_id) as abstract from abstracts where source = '{0}' and coalesce(abstract, '') <> '' group by 1)"


def _from_source(spark, d, source):
    a = table(spark, d, "abstracts").where((F.col("source") == source) & (F.coalesce("abstract", F.lit("")) != ""))
    return aggregates.last_wins(a, ["dblp_key"], ["abstract_id"], unique=True).select("dblp_key", "abstract")


@query(
    f"with o as {_SOURCE.format('doi')}, n as {_SOURCE.format('arxiv')} select coalesce(o.dblp_key, n.dblp_key) as dblp_key, case when n.abstract is not null and "
    "(o.abstract is null or length(n.abstract) > length(o.abstract) * cast(1.05 as double)) then n.abstract else o.abstract end as abstract from o full join n on o.dblp_key = n.dblp_key"
)
def longer_wins_merge(spark, d):
    return merges.longer_wins(_from_source(spark, d, "doi"), _from_source(spark, d, "arxiv"), "dblp_key", "abstract")


@query(
    "select dblp_key, row_idx, title from (select * from papers where venue is null or venue not in ('taco', 'disa') union all "
    "select * from (select * from papers qualify row_number() over (partition by dblp_key order by row_idx desc) = 1) where venue in ('taco', 'disa'))"
)
def replace_scope(spark, d):
    return merges.replace_scope(papers_of(spark, d), valid_of(spark, d), "venue", ["taco", "disa"]).select("dblp_key", "row_idx", "title")


@query("select row_idx, dblp_key, position from paper_authors where dblp_key not in (select dblp_key from papers where venue = 'taco' and dblp_key is not null)")
def delete_children(spark, d):
    return merges.delete_children(table(spark, d, "paper_authors"), papers_of(spark, d), "dblp_key", "venue", ["taco"]).select("row_idx", "dblp_key", "position")


@query(
    "with cur as (select * from papers where year < 2005 qualify row_number() over (partition by dblp_key order by row_idx) = 1), "
    "new as (select * from papers where year >= 2000 and dblp_key <> '' qualify row_number() over (partition by dblp_key order by row_idx desc) = 1) "
    "select dblp_key, row_idx, title from cur where dblp_key not in (select dblp_key from new) union all select dblp_key, row_idx, title from new"
)
def upsert(spark, d):
    p = papers_of(spark, d).select("dblp_key", "row_idx", "title", "year")
    current = aggregates.first_wins(p.where("year < 2005"), ["dblp_key"], ["row_idx"])
    return merges.upsert(current, p.where("year >= 2000"), ["dblp_key"], ["row_idx"]).select("dblp_key", "row_idx", "title")


@query(
    "with n as (select row_idx, unnest(range(len(authors))) as position, unnest(authors, recursive := false) as a from "
    f"{VALID}), fresh as (select a.pid as pid, arg_max(a.name, row_idx * 100000 + position) as name from n where a.pid <> '' group by 1) "
    "select pid, name from authors where pid not in (select pid from fresh) union all select pid, name from fresh"
)
def stored_authors(spark, d):
    papers = papers_of(spark, d)
    links = table(spark, d, "paper_authors").select("dblp_key", "pid", "name", "position")
    return merges.upsert_papers(papers, table(spark, d, "authors"), links, papers)[1]


@query(f"with n as (select dblp_key, unnest(range(len(authors))) as position, unnest(authors, recursive := false) as a from {VALID}) select dblp_key, a.pid as pid, a.name as name, cast(position as integer) as position from n")
def stored_links(spark, d):
    papers = papers_of(spark, d)
    links = table(spark, d, "paper_authors").select("dblp_key", "pid", "name", "position")
    return merges.upsert_papers(papers, table(spark, d, "authors"), links, papers)[2].select("dblp_key", "pid", "name", "position")


@query(
    f"select dblp_key from {VALID} where coalesce(doi, '') = '' or contains(doi, '|') or contains(doi, ',') or dblp_key not in (select dblp_key from abstracts where coalesce(abstract, '') <> '' and dblp_key is not null)"
)
def work_list(spark, d):
    done = table(spark, d, "abstracts").where("coalesce(abstract, '') <> ''").select("dblp_key").distinct()
    return merges.work_list(valid_of(spark, d), done).select("dblp_key")


@query("select distinct toc_key from tocs where toc_key not in (select toc_key from papers where fetched_at >= timestamp '2024-06-01' and toc_key is not null)")
def refresh_pending(spark, d):
    wanted = table(spark, d, "tocs").select("toc_key").distinct()
    return merges.pending(wanted, papers_of(spark, d).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), "toc_key", "2024-06-01")


# --- windows --------------------------------------------------------------------------------------------------------

_ORDER = "venue, year nulls first, title nulls first, dblp_key nulls first, row_idx"


@query(f"select row_idx, row_number() over (order by {_ORDER}) - 1 as ordinal from papers")
def file_order(spark, d):
    return windows.ordinals(papers_of(spark, d).select("row_idx", "venue", "year", "title", "dblp_key"), "venue", "year", "title", "dblp_key", "row_idx").select("row_idx", "ordinal")


_SLOTS = "(select doc_id, text, row_number() over (order by doc_id) - 1 as i from documents)"


@query(f"select i // 200 as shard, count(*) as n, string_agg(text, '|' order by i) as texts from {_SLOTS} group by 1")
def shards(spark, d):
    slots = windows.shard_slots(windows.ordinals(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))
    listed = F.array_sort(F.collect_list(F.struct("slot", "text")))
    return slots.groupBy("shard").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["text"]), "|").alias("texts"))


@query("select (rn - 1) // 50 as batch, string_agg(doi, '|' order by rn) as items from (select lower(doi) as doi, row_number() over (order by lower(doi)) as rn from (select distinct lower(doi) as doi from papers where doi <> '')) group by 1")
def doi_batches(spark, d):
    dois = papers_of(spark, d).where("doi <> ''").select(F.lower("doi").alias("doi")).distinct()
    return windows.batches(windows.ordinals(dois, "doi"), 50, "doi").withColumn("items", F.array_join("items", "|"))


@query("with f as (select name, min(row_idx * 100000 + position) as spot from paper_authors group by name) select name, row_number() over (order by spot) - 1 as number from f")
def author_dictionary(spark, d):
    return windows.dictionary(table(spark, d, "paper_authors"), "name", "row_idx", "position")


@query("select row_idx from papers qualify row_number() over (partition by toc_key, coalesce(nullif(dblp_key, ''), coalesce(title, '') || '|' || array_to_string(list_transform(authors, lambda a: a.name), ',')) order by row_idx) = 1")
def first_in_edition(spark, d):
    return windows.first_in_edition(papers_of(spark, d).select("row_idx", "toc_key", "dblp_key", "title", "authors")).select("row_idx")


@query(
    "with n as (select row_idx, unnest(range(len(authors))) as pos, unnest(authors, recursive := false) as a from papers), "
    "k as (select a.name as name, row_number() over (order by min(row_idx * 100000 + pos)) - 1 as no from n group by a.name), "
    "l as (select row_idx, string_agg(cast(no as varchar), ',' order by pos) as nos from n join k on k.name = n.a.name group by 1) "
    "select dblp_key, v.ord as vid, row_number() over (order by p.year desc nulls last, v.ord, title nulls first, dblp_key nulls first, p.row_idx) - 1 as browse_idx, coalesce(nos, '') as authors "
    "from papers p join venues v on v.slug = p.venue left join l on l.row_idx = p.row_idx where p.title <> ''"
)
def compact_papers(spark, d):
    rows = papers_of(spark, d).where("title <> ''").drop("authors")
    people = report.occurrences(papers_of(spark, d))
    numbers = windows.dictionary(people, "name", "row_idx", "pos", name="no")
    listed = F.array_sort(F.collect_list(F.struct("pos", "no")))
    nos = people.join(numbers, "name").groupBy("row_idx").agg(F.array_join(F.transform(listed, lambda x: x["no"]), ",").alias("authors"))
    venue = table(spark, d, "venues").select(F.col("slug").alias("venue"), F.col("ord").alias("vid"))
    rows = joins.with_dimension(rows, venue, "venue").join(nos, "row_idx", "left")
    placed = windows.ordinals(rows.select("row_idx", "year", "vid", "title", "dblp_key", "authors"), F.desc("year"), "vid", "title", "dblp_key", "row_idx", name="browse_idx")
    return placed.select("dblp_key", "vid", "browse_idx", F.coalesce("authors", F.lit("")).alias("authors"))


@query(f"select row_idx, cast(unnest(range(len(authors))) as integer) as position, unnest(list_transform(authors, lambda a: a.name)) as name from {VALID}")
def author_positions(spark, d):
    return valid_of(spark, d).select("row_idx", F.posexplode("authors.name").alias("position", "name"))


# --- scalar functions -----------------------------------------------------------------------------------------------

_SP = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query(
    f"select row_idx, regexp_replace(coalesce(title, ''), '^{_SP}+|{_SP}+$', '', 'g') as stripped, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as norm, "
    f"trim(regexp_replace(title, '{_SP}+', ' ', 'g')) as spaced, length(title) as n from papers"
)
def title_forms(spark, d):
    t = F.col("title")
    return papers_of(spark, d).select(
        "row_idx", text.strip(F.coalesce(t, F.lit(""))).alias("stripped"), text.norm_title(t).alias("norm"), text.collapse_space(t).alias("spaced"), F.length(t).cast("bigint").alias("n")
    )


@query(
    "select work_id, case when right(t, 1) = '.' and right(t, 2) <> '..' then left(t, length(t) - 1) else t end as title from (select work_id, "
    f"replace(replace(regexp_replace(coalesce(display_name, ''), '^{_SP}+|{_SP}+$', '', 'g'), '&amp;', '&'), '&AMP;', '&') as t from works)"
)
def clean_titles(spark, d):
    return table(spark, d, "works").select("work_id", text.clean_title(F.col("display_name")).alias("title"))


@query(
    "select row_idx, string_agg(regexp_replace(a.raw_name, '^(.*) \\d{4}$', '\\1', 's'), ';' order by pos) as names from "
    "(select row_idx, unnest(range(len(authors))) as pos, unnest(authors, recursive := false) as a from papers) group by 1"
)
def clean_names(spark, d):
    named = papers_of(spark, d).where(F.size("authors") > 0)
    return named.select("row_idx", F.array_join(F.transform("authors", lambda a: text.clean_name(a["raw_name"])), ";").alias("names"))


@query(
    f"select abstract_id, case when length(t) >= 40 and not starts_with(regexp_replace(lower(t), '[^a-z0-9]+', '', 'g'), 'noabstract') then t end as abstract from "
    f"(select abstract_id, trim(regexp_replace(abstract, '{_SP}+', ' ', 'g')) as t from abstracts)"
)
def clean_abstracts(spark, d):
    return table(spark, d, "abstracts").select("abstract_id", text.clean_abstract(F.col("abstract")).alias("abstract"))


@query(
    "select work_id, (select string_agg(w, ' ' order by p, w) from (select e.key as w, unnest(e.value) as p from (select unnest(map_entries(abstract_inverted_index)) as e))) as text from works where abstract_inverted_index is not null"
)
def inverted_to_text(spark, d):
    w = table(spark, d, "works").where("abstract_inverted_index is not null")
    return w.select("work_id", text.inverted_to_text(F.col("abstract_inverted_index")).alias("text"))


@query(f"select abstract_id, nullif(trim(regexp_replace(abstract, '{_SP}+', ' ', 'g')), '') as text from abstracts where abstract is not null")
def inverted_index_round_trip(spark, d):
    a = table(spark, d, "abstracts").where("abstract is not null")
    return a.select("abstract_id", text.inverted_to_text(text.text_to_inverted(F.col("abstract"))).alias("text"))


@query(
    "select toc_key, sha1(toc_key) as url_sha1, left(sha1(toc_key), 2) as folder, replace(replace(url_encode(title), '%20', '+'), '~', '~') as q from (select toc_key, arg_max(title, row_idx) as title "
    "from papers where toc_key is not null and title is not null group by 1)"
)
def url_keys(spark, d):
    rows = papers_of(spark, d).where("toc_key is not null and title is not null")
    last = rows.groupBy("toc_key").agg(F.max_by("title", "row_idx").alias("title"))
    key = text.url_key(F.col("toc_key"))
    return last.select("toc_key", key.alias("url_sha1"), F.left(key, F.lit(2)).alias("folder"), text.quote_plus(F.col("title")).alias("q"))


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k, replace(props, '<', '\\u003c') as safe from events")
def json_fields(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), text.json_for_html(F.col("props")).alias("safe"))


_SEARCH = f"regexp_replace(translate(title, '\"\\', '  '), '^{_SP}+|{_SP}+$', '', 'g')"


@query(
    "select dblp_key, doi <> '' and doi is not null as has_doi, coalesce(contains(doi, '|') or contains(doi, ','), false) as unsafe, "
    f"case when length({_SEARCH}) >= 8 then {_SEARCH} end as search from {VALID}"
)
def lookup_paths(spark, d):
    doi = F.coalesce("doi", F.lit(""))
    return valid_of(spark, d).select("dblp_key", (doi != "").alias("has_doi"), text.unsafe_doi(doi).alias("unsafe"), text.search_query(F.col("title")).alias("search"))


# --- crawl ----------------------------------------------------------------------------------------------------------


@query("select venue, stem, toc_key, cast(case when length(regexp_extract(s, '^(\\d{2,4})', 1)) = 4 then cast(regexp_extract(s, '^(\\d{2,4})', 1) as integer) when length(regexp_extract(s, '^(\\d{2,4})', 1)) >= 2 "
       "then 1900 + cast(regexp_extract(s, '^(\\d{2,4})', 1) as integer) end as integer) as year from (select t.venue, t.stem, t.toc_key, substr(t.stem, length(v.toc_prefix) + 1) as s from tocs t join venues v on v.slug = t.venue)")  # fmt: skip
def link_discovery(spark, d):
    """Index pages are put together from the editions, then read back."""
    tocs, venues = table(spark, d, "tocs"), table(spark, d, "venues")
    link = F.concat(F.lit('<li><a href="https://index.example/db/'), "dblp_dir", F.lit("/"), "stem", F.lit('.html">'), "stem", F.lit("</a>"))
    pages = tocs.join(venues.select(F.col("slug").alias("venue"), "dblp_dir"), "venue").groupBy("venue").agg(F.array_join(F.collect_list(F.concat(link, link)), "\n").alias("body"))
    return crawl.editions(pages, venues)


_PARSED = (
    f"with t as (select *, replace(replace(regexp_replace(coalesce(title, ''), '^{_SP}+|{_SP}+$', '', 'g'), '&amp;', '&'), '&AMP;', '&') as s from papers), "
    "c as (select *, case when right(s, 1) = '.' and right(s, 2) <> '..' then left(s, length(s) - 1) else s end as clean from t) "
    "select dblp_key, venue, coalesce(year, 1999) as year, clean as title, coalesce(pages, '') as pages, coalesce(doi, '') as doi, type, "
    "array_to_string(list_transform(authors, lambda a: a.name || case when row_idx % 7 = 0 then ' \"Q\"' else '' end), ';') as names from c where clean <> '' and type <> 'Editorship' "
    f"and not regexp_matches(clean, '^(?i)({dims.FRONT_MATTER})') qualify row_number() over (partition by toc_key, dblp_key order by row_idx) = 1"
)


@query(_PARSED)
def parse_hits(spark, d):
    """Responses are put together from the papers, then parsed; ids and names must come back.

    Authors come in all forms: a bare string, one object, an array of objects, an array that mixes both; some names
    hold an entity that stands for a quote; pages hold one hit (an object) or several (an array).
    """
    p = papers_of(spark, d)
    name = lambda a: F.when(F.col("row_idx") % 7 == 0, F.concat(a["name"], F.lit(" &quot;Q&quot;"))).otherwise(a["name"])
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"\A\[|\]\z", "")
    person = lambda a: F.when((a["pid"] == "") & (F.col("row_idx") % 2 == 0), quoted(name(a))).otherwise(F.to_json(F.struct(a["pid"].alias("@pid"), name(a).alias("text"))))
    people = F.transform("authors", person)
    bare = (F.size("authors") == 1) & (F.col("row_idx") % 5 > 0)
    author = F.when(bare, F.get(people, 0)).otherwise(F.concat(F.lit("["), F.array_join(people, ","), F.lit("]")))
    info = F.to_json(F.struct("title", F.col("year").cast("string").alias("year"), "pages", "doi", "ee", F.col("dblp_key").alias("key"), F.col("dblp_url").alias("url"), "type", "access"))
    hit = F.concat(F.lit('{"info":'), F.rtrim(info, F.lit("}")), F.lit(',"authors":{"author":'), author, F.lit("}}}"))
    page = p.select("venue", "venue_full", "toc_key", F.floor(F.col("row_idx") / 40).alias("offset"), F.struct("row_idx", hit.alias("hit")).alias("h"))
    hits = F.transform(F.array_sort(F.collect_list("h")), lambda h: h["hit"])
    pages = page.groupBy("venue", "venue_full", "toc_key", "offset").agg(hits.alias("hits"))
    listed = F.when(F.size("hits") == 1, F.get("hits", 0)).otherwise(F.concat(F.lit("["), F.array_join("hits", ","), F.lit("]")))
    body = F.concat(F.lit('{"result":{"hits":{"@total":"1","hit":'), listed, F.lit("}}}"))
    rows = crawl.parse_hits(pages.withColumn("body", body).withColumn("toc_year", F.lit(1999)))
    return rows.select("dblp_key", "venue", "year", "title", "pages", "doi", "type", F.array_join("authors.name", ";").alias("names"))


@query("select toc_key, year from tocs where coalesce(nullif(year, 0), 0) >= 1990 and coalesce(nullif(year, 0), 9999) <= 2010")
def editions_in_range(spark, d):
    return crawl.in_range(table(spark, d, "tocs"), 1990, 2010).select("toc_key", "year")


@query(f"select dblp_key from {VALID} where venue in ('taco', 'meco') and coalesce(nullif(year, 0), 0) >= 2000")
def selected_venues(spark, d):
    known = {r.slug: r for r in table(spark, d, "venues").collect()}
    chosen = dims.select_venues([" TACO", "meco "], known)
    return crawl.in_range(valid_of(spark, d).where(F.col("venue").isin(chosen)), since=2000).select("dblp_key")


# --- sources, sinks, plans ------------------------------------------------------------------------------------------


def _fresh(spark, name):
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("select dblp_key, title, year, doi, len(authors) as n_authors from papers where dblp_key is not null")
def jsonl_round_trip(spark, d):
    path = _fresh(spark, "jsonl")
    names = [c.strip().split(" ")[0] for c in "venue,venue_full,year,title,authors,pages,doi,ee,dblp_key,dblp_url,toc_key,type,access".split(",")]
    files.write_jsonl(papers_of(spark, d).select(*names), path)
    back = files.read_jsonl(spark, path)
    return back.select("dblp_key", "title", "year", "doi", F.size("authors").cast("bigint").alias("n_authors"))


@query("select dblp_key, coalesce(title, '') as title, array_to_string(list_transform(authors, lambda a: a.name), '; ') as authors, cast(len(authors) as integer) as num_authors, coalesce(doi, '') as doi from papers")
def csv_round_trip(spark, d):
    path = _fresh(spark, "csv")
    files.write_csv(files.flat(papers_of(spark, d)), path)
    kinds = ", ".join(f"{c} {'int' if c in ('year', 'num_authors') else 'string'}" for c in files.FLAT)
    return files.read_csv(spark, path, kinds).select("dblp_key", "title", "authors", "num_authors", "doi")


@query("select dblp_key, arg_max(abstract, abstract_id) as abstract from abstracts where coalesce(abstract, '') <> '' group by 1")
def keyed_jsonl(spark, d):
    path = _fresh(spark, "keyed")
    rows = table(spark, d, "abstracts").where("coalesce(abstract, '') <> ''")
    rows = rows.repartitionByRange(6, "abstract_id").sortWithinPartitions("abstract_id").select("dblp_key", "abstract")
    files.write_jsonl(rows, path)
    return files.read_jsonl_keyed(spark, path)


@query("select venue, count(*) as n, count(distinct dblp_key) as n_keys from papers group by venue")
def partitioned_tables(spark, d):
    """Written by venue, one venue then replaced with itself: the other partitions stay."""
    path = _fresh(spark, "tables")
    p = papers_of(spark, d).select("dblp_key", "row_idx", "venue")
    files.write_tables({"papers": p}, path, {"papers": "venue"})
    files.write_tables({"papers": p.where("venue = 'taco'")}, path, {"papers": "venue"})
    return spark.read.parquet(f"{path}/papers").groupBy(F.col("venue").cast("string")).agg(F.count("*").alias("n"), F.count_distinct("dblp_key").alias("n_keys"))


@query(f"select dblp_key, row_idx, title from {VALID} where dblp_key is not null")
def streamed_upsert(spark, d):
    """Files of new rows merged as they come: the last delivery of each key is left."""
    folder, target = _fresh(spark, "incoming"), _fresh(spark, "merged")
    p = papers_of(spark, d).select("dblp_key", "row_idx", "title").where("dblp_key is not null")
    p.repartition(4, "row_idx").write.parquet(folder)
    refresh.upsert_stream(spark, folder, p.schema, target, ["dblp_key"], ["row_idx"], files_per_batch=2)
    return refresh.current(spark, target).select("dblp_key", "row_idx", "title")


def preprint_feed(papers: DataFrame, works: DataFrame, abstracts: DataFrame) -> DataFrame:
    """``id, summary``: the preprint texts, each under the id that the last work of its paper's DOI names.

    A text whose paper has no such id cannot be asked for by id, so it is no entry.
    """
    doi = text.bare_doi(F.col("doi"), "https://doi.example/")
    ids = aggregates.last_wins(works.select("work_id", doi.alias("_doi"), "locations").where("_doi <> ''"), ["_doi"], ["work_id"])
    ids = ids.select("_doi", text.arxiv_of_locations(F.col("locations"), ARXIV_TEST).alias("_id")).where("_id is not null")
    keys = papers.where("doi <> ''").select("dblp_key", F.lower("doi").alias("_doi")).join(ids, "_doi")
    texts = abstracts.where("source = 'arxiv'").select("dblp_key", F.col("abstract").alias("summary"))
    return texts.join(keys, "dblp_key").select(F.concat(F.lit("https://arxiv.example/abs/"), "_id").alias("id"), "summary")


def _sql_clean(value: str) -> str:
    spaced = f"trim(regexp_replace({value}, '{_SP}+', ' ', 'g'))"
    return f"(case when length({spaced}) >= 40 and not starts_with(regexp_replace(lower({spaced}), '[^a-z0-9]+', '', 'g'), 'noabstract') then {spaced} end)"


_ID = (
    "regexp_extract(list_filter(flatten(list_transform(locations, lambda l: [l.landing_page_url, l.pdf_url])), lambda u: regexp_matches(u, "
    "'(?i)arxiv\\.example/(abs|pdf)/([a-z-]+(\\.[A-Z]{2})?/\\d{7}|\\d{4}\\.\\d{4,5})'))[1], '(?i)arxiv\\.example/(?:abs|pdf)/([a-z-]+(?:\\.[A-Z]{2})?/\\d{7}|\\d{4}\\.\\d{4,5})', 1)"
)
_ENRICHED = f"""
with v as {VALID},
t as (select work_id, string_agg(w, ' ' order by p, w) as x from (select work_id, e.key as w, unnest(e.value) as p from (select work_id, unnest(map_entries(abstract_inverted_index)) as e from works)) group by 1),
w as (select work_id, lower(replace(coalesce(doi, ''), 'https://doi.example/', '')) as k, display_name, publication_year as y, nullif({_ID}, '') as aid, {_sql_clean('t.x')} as txt from works left join t using (work_id)),
wt as (select k, arg_max(txt, work_id) filter (txt is not null) as txt, arg_max(aid, work_id) filter (aid is not null) as aid from w where k <> '' group by 1),
p as (select lower(doi) as k, arg_max(dblp_key, row_idx) as dblp_key from v where doi <> '' and not contains(doi, '|') and not contains(doi, ',') group by 1),
d as (select dblp_key, txt, aid from p join wt using (k)),
last as (select k, arg_max(struct_pack(a := aid), work_id).a as aid from w where k <> '' group by 1),
feed as (select last.aid as aid, {_sql_clean('abstract')} as txt from abstracts join v using (dblp_key) join last on last.k = lower(v.doi) where abstracts.source = 'arxiv' and last.aid is not null and v.doi <> ''),
longer as (select dblp_key, arg_max(feed.txt, (length(feed.txt), feed.txt)) as txt from d join feed on feed.aid = d.aid where feed.txt is not null group by 1),
o as (select dblp_key, txt from d where txt is not null),
f as (select coalesce(o.dblp_key, n.dblp_key) as dblp_key, case when n.txt is not null and (o.txt is null or length(n.txt) > length(o.txt) * cast(1.05 as double)) then n.txt else o.txt end as txt from o full join longer n on o.dblp_key = n.dblp_key),
todo as (select dblp_key, year, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as nt from v where (coalesce(doi, '') = '' or contains(doi, '|') or contains(doi, ',') or dblp_key not in (select dblp_key from f)) and length({_SEARCH}) >= 8),
m as (select todo.dblp_key, arg_min(struct_pack(x := w.txt), w.work_id).x as txt from todo join w on regexp_replace(lower(w.display_name), '[^a-z0-9]+', '', 'g') = nt where nt <> '' and (w.y is null or w.y = 0 or abs(w.y - todo.year) <= 1) group by 1)
select dblp_key, txt as abstract from f union all select dblp_key, txt from m where txt is not null and dblp_key not in (select dblp_key from f)
"""


@query(_ENRICHED)
def enriched(spark, d):
    """Abstracts of papers by the whole lookup plan; the preprint feed is the abstracts of that source."""
    feed = preprint_feed(valid_of(spark, d), table(spark, d, "works"), table(spark, d, "abstracts"))
    return enrich.enrich(valid_of(spark, d), table(spark, d, "works"), feed, pattern=ARXIV_TEST, doi_prefix="https://doi.example/")


_TOPICS = ", ".join(f"'{t}'" for t in dims.topic_ids())
_COMPACT = (
    f"with l as (select * from {LABELLED} where title <> ''), n as (select row_idx, unnest(range(len(authors))) as pos, unnest(authors, recursive := false) as a from l), "
    "k as (select a.name as name, row_number() over (order by min(row_idx * 100000 + pos)) - 1 as no from n group by a.name), "
    "s as (select row_idx, string_agg(cast(no as varchar), ',' order by pos) as nos from n join k on k.name = n.a.name group by 1), "
    "c as (select dblp_key, v.ord as vid, row_number() over (order by l.year desc nulls last, v.ord, title nulls first, dblp_key nulls first, l.row_idx) - 1 as browse_idx, coalesce(nos, '') as authors, "
    f"array_to_string(list_transform(labels, lambda x: list_position([{_TOPICS}], x) - 1), ',') as topics from l join venues v on v.slug = l.venue left join s on s.row_idx = l.row_idx) "
)


def _compacted(spark, d):
    return report.compact(labelled_of(spark, d).where("title <> ''"), table(spark, d, "venues"))


@query(_COMPACT + "select * from c")
def compact_report(spark, d):
    """Papers in browse order, dictionary-encoded, with their topics."""
    c = _compacted(spark, d)
    return c.select("dblp_key", "vid", "browse_idx", F.array_join("author_nos", ",").alias("authors"), F.array_join("topic_nos", ",").alias("topics"))


@query(
    _COMPACT + ", a as (select dblp_key, arg_max(abstract, abstract_id) as abstract from abstracts where coalesce(abstract, '') <> '' group by 1) "
    "select browse_idx // 200 as shard, count(*) as n, md5(string_agg(coalesce(abstract, ''), '|' order by browse_idx)) as digest from c left join a using (dblp_key) group by 1"
)
def report_shards(spark, d):
    """Shards of abstracts in browse order, as they are published."""
    a = table(spark, d, "abstracts").where("coalesce(abstract, '') <> ''")
    last = aggregates.last_wins(a, ["dblp_key"], ["abstract_id"], unique=True).select("dblp_key", "abstract")
    return report.shards(_compacted(spark, d), last).select("shard", F.size("texts").cast("bigint").alias("n"), F.md5(F.array_join("texts", "|")).alias("digest"))


@query(
    f"with l as (select *, {BUCKET} as bucket from {LABELLED}), x as (select *, unnest(labels) as topic from l) "
    "select 'per_venue_year' as part, venue as outer_key, coalesce(cast(year as varchar), 'None') as inner_key, count(*) as n from l group by all "
    "union all select 'topic_by_venue', venue, topic, count(*) from x group by all union all select 'topic_by_bucket', bucket, topic, count(*) from x where bucket is not null group by all "
    "union all select 'bucket_total', bucket, '', count(*) from l where bucket is not null group by all"
)
def report_document(spark, d):
    """The nested counts of the report document, as rows."""
    doc = report.build(valid_of(spark, d), table(spark, d, "venues"))
    rows = [(part, o, i, n) for part in ("per_venue_year", "topic_by_venue", "topic_by_bucket") for o, inner in doc[part].items() for i, n in inner.items()]
    rows += [("bucket_total", b, "", n) for b, n in doc["bucket_total"].items()]
    return spark.createDataFrame(rows, "part string, outer_key string, inner_key string, n bigint")


@query(
    f"with v as (select * from {VALID} where dblp_key <> ''), n as (select dblp_key, unnest(range(len(authors))) as position, unnest(authors, recursive := false) as a from v) "
    "select 'papers' as name, count(*) as n, cast(coalesce(sum(year), 0) as bigint) as total from v union all select 'authors', count(distinct a.pid), 0 from n where a.pid <> '' "
    "union all select 'paper_authors', count(*), cast(sum(position) as bigint) from n"
)
def sqlite_tables(spark, d):
    """The three stored tables of the SQLite sink, read back."""
    with tempfile.TemporaryDirectory() as folder:  # the sink is one file of the driver
        files.write_sqlite(papers_of(spark, d), f"{folder}/papers.db")
        with sqlite3.connect(f"{folder}/papers.db") as db:
            one = lambda q: db.execute(q).fetchone()[0]
            rows = [(t, one(f"select count(*) from {t}"), one(f"select coalesce(sum({c}), 0) from {t}")) for t, c in (("papers", "year"), ("authors", "0"), ("paper_authors", "position"))]
    return spark.createDataFrame(rows, "name string, n bigint, total bigint")


def _offline_pages(spark, d):
    """Pages of five hits for every edition; every seventh edition's server fails after the first page."""
    http.register(spark)
    n = papers_of(spark, d).where("toc_key is not null").groupBy("toc_key").agg(F.count("*").alias("n")).collect()  # editions are a fixed table
    wanted = [f"{r.toc_key}#{r.n}" + ("!5" if len(r.toc_key) % 7 == 0 else "") for r in n]
    given = {"url": "https://search.example/api", "queries": json.dumps(wanted), "pageSize": 5, "delay": 0, "opener": "lectern.sources.offline:paged"}
    return spark.read.format("lectern_pages").options(**given).load()


_EXPECTED = "(select toc_key, count(*) as n, length(toc_key) % 7 = 0 as bad from papers where toc_key is not null group by 1)"


@query(f"select toc_key, n as expected, case when bad then least(n, 5) else n end as fetched, not bad or n <= 5 as complete from {_EXPECTED}")
def crawl_status(spark, d):
    """Rows expected and received per edition, from a paged source that fails for some."""
    s = crawl.status(_offline_pages(spark, d))
    return s.select(F.regexp_extract("query", "(.*)#", 1).alias("toc_key"), F.col("expected").cast("bigint").alias("expected"), "fetched", "complete")


@query(
    "select cast(sum(case when not bad then (n + 4) // 5 when n <= 5 then 1 else 2 end) as bigint) as requests, cast(0 as bigint) as cached, cast(0 as bigint) as retries, "
    f"count(*) filter (bad and n > 5) as failed from {_EXPECTED}"
)
def http_counters(spark, d):
    """What the client counted over all requests of a crawl."""
    return lookup.counters(_offline_pages(spark, d))


@query("select doi, 'Work ' || doi as display_name, doi || ' text' as text from (select distinct lower(doi) as doi from papers where doi <> '' and not contains(doi, '|') and not contains(doi, ',')) where length(doi) % 2 = 0")
def doi_lookup(spark, d):
    """Works looked up in batches of fifty DOIs, from answers that are kept."""
    dois = papers_of(spark, d).where("doi <> ''").where(~text.unsafe_doi(F.col("doi"))).select(F.lower("doi").alias("doi"))
    given = {"opener": "lectern.sources.offline:lookup", "delay": 0}
    works = lookup.works_of(lookup.fetch(spark, dois, "doi", "doi", "https://works.example/api", _fresh(spark, "answers"), given, group=400))
    return works.select("doi", "display_name", F.array_join(F.sort_array(F.map_keys("abstract_inverted_index")), " ").alias("text"))


@query("select toc_key as id, replace(stem, '&', '&amp;') || ' & more' as summary from tocs")
def feed_entries(spark, d):
    """Answers in the form of Atom feeds, one file each, written and read back; entities are resolved."""
    path = _fresh(spark, "feed")
    entry = F.concat(F.lit("<entry><id>"), "toc_key", F.lit("</id><summary>"), F.replace("stem", F.lit("&"), F.lit("&amp;amp;")), F.lit(" &amp; more</summary></entry>"))
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.collect_list(entry), "\n"), F.lit("</feed>"))
    table(spark, d, "tocs").groupBy("venue").agg(feed.alias("value")).select("value").write.text(path)
    return lookup.entries_of(files.read_pages(spark, path))


@query("select toc_key, row_number() over (order by coalesce(year, 0), stem, toc_key) - 1 as ordinal from tocs")
def sorted_editions(spark, d):
    return crawl.sorted_editions(table(spark, d, "tocs").select("toc_key", "stem", "year")).select("toc_key", "ordinal")


@query("select row_idx, venue from papers where venue in (select slug from venues)")
def bag_union(spark, d):
    """Rows of all venues put together, repeats kept."""
    p = papers_of(spark, d).select("row_idx", "venue")
    parts = [p.where(F.col("venue") == r.slug) for r in table(spark, d, "venues").select("slug").collect()]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"select aid, row_number() over (order by aid) - 1 as ordinal from (select distinct {_ID} as aid from works) where aid <> ''")
def sorted_arxiv_ids(spark, d):
    """Distinct preprint ids in order, as they are asked for."""
    ids = table(spark, d, "works").select(text.arxiv_of_locations(F.col("locations"), ARXIV_TEST).alias("aid")).where("aid is not null").distinct()
    return windows.ordinals(ids, "aid")


@query("select dblp_key, arg_max(abstract, abstract_id) as abstract from abstracts where coalesce(abstract, '') <> '' group by 1")
def atomic_jsonl(spark, d):
    """The atomic sink, written over an older version of itself."""
    path = _fresh(spark, "atomic")
    a = table(spark, d, "abstracts").where("coalesce(abstract, '') <> ''")
    last = aggregates.last_wins(a, ["dblp_key"], ["abstract_id"], unique=True).select("dblp_key", "abstract")
    files.write_atomic(last.where("abstract like 'A%'"), path, "dblp_key")
    files.write_atomic(last, path, "dblp_key")
    return files.read_jsonl(spark, path, files.ABSTRACTS)


_VIEWS = "select v.name, count(*) as n, count(distinct p.dblp_key) as n_keys from papers p join venues v on v.slug = p.venue where p.year >= 2000 group by v.name"


@query(_VIEWS)
def sql_over_views(spark, d):
    """The same SQL, over temporary views of the tables."""
    register_views(spark, d)
    return spark.sql(_VIEWS)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
