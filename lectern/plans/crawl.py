"""From raw pages to papers: one lazy plan that can be run again offline from cached bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dims, text
from lectern.operators import windows

HIT = "array<struct<info:struct<title:string,year:string,pages:string,doi:string,ee:string,key:string,url:string,type:string,access:string,authors:string>>>"


def editions(pages: DataFrame, venues: DataFrame) -> DataFrame:
    """``venue, stem, toc_key, year`` of the editions linked from index pages ``venue, body``, each once, in no order; ``sorted_editions`` puts them in order."""
    joined = pages.join(venues.select(F.col("slug").alias("venue"), "dblp_dir", "toc_prefix"), "venue")
    links = joined.select("venue", "dblp_dir", "toc_prefix", F.explode(text.edition_links(F.col("body"), F.col("dblp_dir"), F.col("toc_prefix"))).alias("stem"))
    return links.select(
        "venue", "stem", F.concat(F.lit("db/"), "dblp_dir", F.lit("/"), "stem", F.lit(".bht")).alias("toc_key"),
        text.year_of_stem(F.col("stem"), F.col("toc_prefix")).alias("year"),
    ).distinct()


def sorted_editions(tocs: DataFrame) -> DataFrame:
    """Editions in the order they are crawled in, with their place: an unknown year comes first, then by year and stem."""
    return windows.ordinals(tocs.withColumn("_y", F.coalesce("year", F.lit(0))), "_y", "stem", "toc_key").drop("_y")


def in_range(df: DataFrame, since: int | None = None, until: int | None = None, year: str = "year") -> DataFrame:
    """Rows within the years; an unknown year (NULL or 0) is outside of either bound."""
    y = F.nullif(F.col(year), F.lit(0))
    if since is not None:
        df = df.where(F.coalesce(y, F.lit(0)) >= since)
    if until is not None:
        df = df.where(F.coalesce(y, F.lit(9999)) <= until)
    return df


def hits_of(body: Column) -> Column:
    """Hits of one page as an array; a single hit and no hit are arrays too."""
    hit = F.get_json_object(body, "$.result.hits.hit")
    return F.coalesce(F.from_json(hit, HIT), F.from_json(F.lit("[]"), HIT))


def authors_of(authors: Column) -> Column:
    """Names and ids from the polymorphic field: a string, an object, or an array that mixes both. Empty names are dropped."""
    v = F.try_variant_get(F.try_parse_json(authors), "$.author", "variant")
    many = F.schema_of_variant(v).startswith("ARRAY")
    items = F.when(v.isNull(), F.array().cast("array<variant>")).when(many, F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    name = lambda x: F.coalesce(
        F.try_variant_get(x, "$.text", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit("")
    )
    pid = lambda x: F.coalesce(F.try_variant_get(x, '$["@pid"]', "string"), F.lit(""))
    return F.filter(F.transform(items, lambda x: F.struct(name(x).alias("name"), pid(x).alias("pid"))), lambda a: a["name"] != "")


def parse_hits(pages: DataFrame, include_editorship: bool = False, include_front_matter: bool = False) -> DataFrame:
    """Papers from ``venue, venue_full, toc_key, toc_year, offset, body``, in page order, first copy of an edition kept."""
    hits = pages.select("venue", "venue_full", "toc_key", "toc_year", "offset", F.posexplode(hits_of(F.col("body"))).alias("place", "hit"))
    i = lambda c: F.coalesce(F.col(f"hit.info.{c}"), F.lit(""))
    # names are taken out of the JSON first: an entity in it may stand for a quote
    hits = hits.withColumn("_people", authors_of(F.col("hit.info.authors")))
    hits = hits.withColumn("_names", text.unescape_all(F.col("_people.name")))
    people = F.zip_with("_people", "_names", lambda a, n: F.struct(n.alias("name"), a["pid"].alias("pid")))
    rows = hits.select(
        "venue", "venue_full", text.record_year(F.col("hit.info.year"), F.col("toc_year")).alias("year"), text.clean_title(i("title")).alias("title"),
        F.transform(people, lambda a: F.struct(text.clean_name(a["name"]).alias("name"), a["name"].alias("raw_name"), a["pid"].alias("pid"))).alias("authors"),
        i("pages").alias("pages"), i("doi").alias("doi"), i("ee").alias("ee"), i("key").alias("dblp_key"), i("url").alias("dblp_url"), "toc_key",
        i("type").alias("type"), i("access").alias("access"), (F.col("offset").cast("bigint") * 1000 + F.col("place")).alias("row_idx"),
    ).where("title <> ''")
    if not include_editorship:
        rows = rows.where("type <> 'Editorship'")
    if not include_front_matter:
        rows = rows.where(~F.col("title").rlike(f"(?i)^({dims.FRONT_MATTER})"))
    return windows.first_in_edition(rows)


def status(pages: DataFrame) -> DataFrame:
    """For each query the rows expected and received and whether it is complete; failed pages make it incomplete."""
    got = pages.select("query", "offset", "total", "error", F.size(hits_of(F.col("body"))).alias("n"))
    return got.groupBy("query").agg(
        F.max("total").alias("expected"), F.sum(F.greatest("n", F.lit(0))).alias("fetched"), F.max(F.when(F.col("error") != "", F.col("error"))).alias("error")
    ).withColumn("complete", F.col("error").isNull() & (F.col("fetched") >= F.coalesce("expected", F.lit(0))))
