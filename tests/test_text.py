"""Scalar functions against values worked out by hand."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import dims, text


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string")
    return [r[0] for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").select("v").collect()]


def test_titles_and_names(spark):
    assert values(spark, text.clean_title, " A &amp; B. ", "X..", ".", None, "P vs. NP?", "Caf&eacute;\u00a0") == ["A & B", "X..", "", "", "P vs. NP?", "Café"]
    assert values(spark, text.clean_name, "Ann Lee 0001", "Ann Lee 001", "0001", "Ann\nLee 0002", None) == ["Ann Lee", "Ann Lee 001", "0001", "Ann\nLee", None]
    assert values(spark, text.norm_title, "On P/poly!", "北京", None) == ["onppoly", "", None]
    assert values(spark, text.collapse_space, " a\u00a0\u2003b\x1c c ", "", None) == ["a b c", "", None]


def test_abstracts(spark):
    long = "An abstract that has clearly more than forty characters."
    assert values(spark, text.clean_abstract, long, "short", "No abstract available, but these words are many more.", None, "") == [long, None, None, None, None]


def test_topics_terms_buckets(spark):
    assert values(spark, text.classify, "Quantum graph games", "Nothing here", "polynomial time", "Polynomials", None, "al\u200dgebraic") == [
        ["graph", "quantum", "game"], ["other"], ["other"], ["algebraic"], ["other"], ["other"],
    ]
    assert values(spark, text.title_terms, "The new zig-zag o'neil graph Graph", "", None) == [["zig-zag", "o'neil", "graph", "graph"], [], []]
    assert values(spark, lambda c: text.bucket(c.cast("int")), "1997", "-3", None) == ["1995-1999", "-5--1", None]


def test_urls_and_years(spark):
    assert values(spark, text.quote_plus, "a b~*é/") == ["a+b~%2A%C3%A9%2F"]
    stem = lambda c: text.year_of_stem(c, F.lit("stoc"))
    assert values(spark, stem, "stoc2023", "stoc69", "stoc123", "stoc7", "stocx", "stoc20234") == [2023, 1969, 2023, None, None, 2023]
    year = lambda c: text.record_year(c, F.lit(1999))
    assert values(spark, year, "2001", "", None, "MMXX") == [2001, 1999, 1999, 1999]
    assert values(spark, text.arxiv_of_url, "http://arxiv.org/abs/1234.56789v2", "https://doi.org/10.48550/arXiv.CS/0101001", "x", None) == ["1234.56789", "CS/0101001", "", ""]
    assert values(spark, text.search_query, 'A "quoted" title', "short", None) == ["A  quoted  title", None, None]
    assert values(spark, text.json_for_html, '{"a":"</script>"}') == ['{"a":"\\u003c/script>"}']
    assert values(spark, text.bare_doi, "https://doi.org/10.1/AB", None) == ["10.1/ab", ""]


def test_rounding_and_dates_are_half_even(spark):
    row = spark.sql("select 0.125d as a, 0.375d as b").select(text.round_half_even(F.col("a"), 2), text.round_half_even(F.col("b"), 2)).first()
    assert tuple(row) == (0.12, 0.38)
    assert datetime.date(2024, 1, 1).year == 2024


def test_unknown_venue():
    assert dims.select_venues([" Taco "], {"taco": 1}) == ["taco"]
    with pytest.raises(ValueError):
        dims.select_venues(["nope"], {"taco": 1})


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcé ", max_size=12), min_size=1, max_size=6))
def test_inverted_index_round_trip(spark, texts):
    got = values(spark, lambda c: text.inverted_to_text(text.text_to_inverted(c)), *texts)
    assert got == [" ".join(t.split()) or None for t in texts]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=15), min_size=1, max_size=6))
def test_norm_title_twice_is_once(spark, texts):
    once = values(spark, text.norm_title, *texts)
    assert values(spark, text.norm_title, *once) == once
