"""Scalar text functions: Column in, Column out, all in the JVM but ``unescape_html``."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import dims

# white space as Unicode has it; Java's class lacks the four separators of ASCII
SPACE = r"[\s\x1c-\x1f]"


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_html(c: Column) -> Column:
    """Named and numeric entities resolved. Only values with an ampersand leave the JVM."""
    odd = F.when(c.contains("&"), c)
    return F.coalesce(_unescape(odd), c)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: [html.unescape(x) if x is not None else None for x in xs], na_action="ignore")


def unescape_all(c: Column) -> Column:
    """``unescape_html`` of every string of an array, in one Arrow call."""
    odd = F.when(F.exists(c, lambda x: x.contains("&")), c)
    return F.coalesce(_unescape_all(odd), c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def classify(title: Column, rules=None) -> Column:
    """Array of topic ids whose rule matches, in rule order; ``['other']`` if none does. NULL is read as empty.

    Java counts marks and joiners as parts of words, the rules were written for a dialect that does not: they become a
    character that is part of no word.
    """
    text = F.regexp_replace(F.coalesce(title, F.lit("")), r"[\p{M}\u200c\u200d]", "\u200b")
    marks = [F.when(text.rlike("(?iU)" + pattern), F.lit(topic)) for topic, _, _, pattern in dims.topic_rules(rules)]
    hits = F.array_compact(F.array(*marks))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(dims.OTHER)))


def title_terms(title: Column, stopwords: list[str] | None = None) -> Column:
    """Words of three or more letters in the lower-cased title, without stopwords, repeats kept."""
    stop = F.array(*[F.lit(w) for w in sorted(set(dims.STOPWORDS if stopwords is None else stopwords))])
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"([a-z][a-z\-']{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def bucket(year: Column, width: int = 5) -> Column:
    """``1995-1999`` for 1997; floors for negative years too. NULL stays NULL."""
    start = year - F.pmod(year, F.lit(width))
    return F.concat(start.cast("string"), F.lit("-"), (start + width - 1).cast("string"))


def clean_title(title: Column) -> Column:
    """Entities resolved, stripped, one closing full stop dropped unless there are two."""
    text = strip(unescape_html(F.coalesce(title, F.lit(""))))
    return F.regexp_replace(text, r"(?<!\.)\.\z", "")


def clean_name(name: Column) -> Column:
    """Without the four-digit number that tells homonyms apart."""
    return F.regexp_replace(name, r"(?sU)\A(.*) \d{4}\z", "$1")


def norm_title(title: Column) -> Column:
    """Only ``a-z0-9`` of the lower-cased title."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")


def clean_abstract(text: Column, least: int = 40) -> Column:
    """White space collapsed; NULL if that leaves fewer than ``least`` characters or a placeholder."""
    c = collapse_space(text)
    return F.when((F.length(c) >= least) & ~norm_title(c).startswith("noabstract"), c)


def inverted_to_text(index: Column) -> Column:
    """Text of a map from word to positions; NULL for a NULL or empty map. Stays within the row."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("p"), e["key"].alias("w")))))
    text = F.trim(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "))
    return F.nullif(text, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def text_to_inverted(text: Column) -> Column:
    """Map from word to its positions, counted from 0: the inverse of ``inverted_to_text`` up to white space.

    Words are sorted with their positions; each run of equal words is one entry.
    """

    def from_sorted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        return let(
            starts,
            lambda b: F.map_from_arrays(
                F.transform(b, lambda i: F.get(s, i)["w"]),
                F.transform(b, lambda i, k: F.transform(F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i), lambda x: x["i"])),
            ),
        )

    words = F.split(collapse_space(text), " ")
    return let(F.array_sort(let(words, lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))), from_sorted)


# Fixed value: the forms of preprint links that are known.
ARXIV = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|10\.48550/arxiv\.)([a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})"


def arxiv_of_url(url: Column, pattern: str = ARXIV) -> Column:
    """Preprint id in a URL, ``""`` if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1)


def arxiv_of_locations(locations: Column, pattern: str = ARXIV) -> Column:
    """First id among the locations in order, landing page before PDF; NULL if there is none."""
    urls = F.flatten(F.transform(locations, lambda l: F.array(l["landing_page_url"], l["pdf_url"])))
    ids = F.filter(F.transform(urls, lambda u: arxiv_of_url(u, pattern)), lambda x: x != "")
    return F.get(ids, 0)


def bare_doi(doi: Column, prefix: str = "https://doi.org/") -> Column:
    return F.lower(F.replace(F.coalesce(doi, F.lit("")), F.lit(prefix), F.lit("")))


def unsafe_doi(doi: Column) -> Column:
    """True for DOIs that hold a separator of the lookup language."""
    return doi.contains("|") | doi.contains(",")


def search_query(title: Column) -> Column:
    """Title as a search phrase: quotes and backslashes blanked; NULL if fewer than 8 characters are left."""
    q = strip(F.translate(title, '"\\', "  "))
    return F.when(F.length(q) >= 8, q)


def edition_links(body: Column, folder: Column, prefix: Column) -> Column:
    """Distinct stems of the edition pages linked from an index page."""
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    pattern = F.concat(F.lit("("), quoted(folder), F.lit("/"), quoted(prefix), F.lit(r"[0-9][A-Za-z0-9\-]*\.html)"))
    paths = F.regexp_extract_all(body, pattern, F.lit(1))
    return F.array_distinct(F.transform(paths, lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.html\z", "")))


def year_of_stem(stem: Column, prefix: Column) -> Column:
    """Year guessed from a stem: four digits as they are, fewer count from 1900, one or none give NULL."""
    digits = F.regexp_extract(F.substr(stem, F.length(prefix) + 1), r"\A(\d{2,4})", 1)
    number = digits.try_cast("int")
    return F.when(F.length(digits) == 4, number).when(F.length(digits) >= 2, number + 1900)


def record_year(year: Column, edition_year: Column) -> Column:
    """The record's year, else the edition's, else 0; a bad value counts as none."""
    own = F.when(F.coalesce(year, F.lit("")) != "", year)
    return F.coalesce(F.when(own.isNotNull(), own.try_cast("int")), edition_year, F.lit(0))


def round_half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def url_key(url: Column) -> Column:
    return F.sha1(url)


def quote_plus(text: Column) -> Column:
    """Form encoding: blanks as ``+``, ``~`` kept, ``*`` encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def json_for_html(js: Column) -> Column:
    """JSON that cannot close the element it stands in."""
    return F.replace(js, F.lit("<"), F.lit("\\u003c"))


def or_else(c: Column, other: Column) -> Column:
    """``other`` where ``c`` is NULL or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)
