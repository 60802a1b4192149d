"""Operators against small tables, plain Python and the shipped SQL."""

import json
import sqlite3
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from lectern.functions import dims  # noqa: E402
from lectern.operators import aggregates, joins, merges, windows  # noqa: E402
from lectern.plans import catalogue, crawl, report  # noqa: E402
from lectern.sources import files, http  # noqa: E402

SMALL = "/root/testdata/sf0.001"
PAPERS = files.PAPERS + ", row_idx bigint"


def paper(i, key="k", title="On graphs", year=2020, venue="v", authors=(), **more):
    row = dict.fromkeys([c.strip().split(" ")[0] for c in "venue_full,pages,doi,ee,dblp_url,toc_key,type,access".split(",")], "")
    return row | {"row_idx": i, "dblp_key": key, "title": title, "year": year, "venue": venue, "authors": [{"name": n, "raw_name": n, "pid": p} for n, p in authors]} | more


def table(spark, *rows):
    return spark.createDataFrame(list(rows), PAPERS)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = catalogue.QUERIES[name](spark, SMALL)
    cursor = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    show = lambda v: "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    left = sorted(tuple(show(r[c]) for c in columns) for r in df.collect())
    assert left == sorted(tuple(map(show, r)) for r in cursor.fetchall())


def test_last_and_first_wins(spark):
    t = table(spark, paper(1, title="a"), paper(3, title="c"), paper(2, title="b"), paper(4, key=None))
    assert {(r.dblp_key, r.title) for r in aggregates.last_wins(t, ["dblp_key"], ["row_idx"]).collect()} == {("k", "c"), (None, "On graphs")}
    assert aggregates.first_wins(t.where("dblp_key = 'k'"), ["dblp_key"], ["row_idx"]).first().title == "a"
    assert aggregates.last_wins(t.limit(0), ["dblp_key"], ["row_idx"]).count() == 0


def test_ordinals_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    for n in (1, 7):
        rows = windows.ordinals(df.repartition(n), "x").collect()
        assert all(r.x == r.ordinal for r in rows) and len(rows) == 1000
    assert windows.ordinals(df.limit(0), "x").count() == 0


def test_longer_wins(spark):
    old = spark.createDataFrame([("a", "x" * 100), ("b", "x" * 100), ("c", "x")], "k string, t string")
    new = spark.createDataFrame([("a", "y" * 105), ("b", "y" * 106), ("d", "y")], "k string, t string")
    assert {r.k: r.t[0] for r in merges.longer_wins(old, new, "k", "t").collect()} == {"a": "x", "b": "y", "c": "x", "d": "y"}


def test_longer_preprints_replace_texts(spark, tmp_path):
    """``enriched`` against plain Python: preprint texts reach their papers by the ids in the works' locations."""
    words = lambda n, c: " ".join(c * 5 for _ in range(n))
    papers = [paper(i, key=f"k{i}", title=f"A title of paper number {i}", doi=f"10.1234/{'B' if i == 4 else 'b'}{i}") for i in range(6)]
    papers.append(paper(9, key="k9", title="A title of paper number 9", doi="10.1234/b1"))
    url = lambda i: [{"landing_page_url": None, "pdf_url": f"https://arxiv.example/pdf/2301.0000{i}v2"}]
    works = [(i, f"https://doi.example/10.1234/b{i}", f"Work {i}", 2020, None if i == 3 else words(20, "w"), [] if i == 5 else url(i)) for i in range(6)]
    preprints = [("k0", words(30, "p")), ("k0", words(25, "q")), ("k1", words(20, "p")), ("k2", "short"), ("k3", words(8, "p")), ("k4", words(22, "p")), ("k5", words(90, "p")), ("k9", words(40, "p"))]
    table(spark, *papers).write.parquet(str(tmp_path / "papers.parquet"))
    kinds = "work_id bigint, doi string, display_name string, publication_year int, words string, locations array<struct<landing_page_url:string,pdf_url:string>>"
    found = spark.createDataFrame(works, kinds)
    index = F.when(F.col("words").isNotNull(), F.map_from_arrays(F.array(F.lit("wwwww")), F.array(F.sequence(F.lit(0), F.lit(19)))))
    found.withColumn("abstract_inverted_index", index).drop("words").write.parquet(str(tmp_path / "works.parquet"))
    rows = [(i, k, t, "arxiv") for i, (k, t) in enumerate(preprints)] + [(99, "k1", words(99, "m"), "mirror")]
    spark.createDataFrame(rows, "abstract_id bigint, dblp_key string, abstract string, source string").write.parquet(str(tmp_path / "abstracts.parquet"))

    expected = {}
    last = {p["doi"].lower(): p["dblp_key"] for p in papers}  # of papers with one DOI the last is looked up
    for p in papers:
        for _, doi, _, _, text, locations in works:
            if doi.endswith("/" + p["doi"].lower()) and last[p["doi"].lower()] == p["dblp_key"]:
                expected[p["dblp_key"]] = text
                sharing = {q["dblp_key"] for q in papers if q["doi"].lower() == p["doi"].lower()}
                for new in sorted((t for k, t in preprints if k in sharing and locations and len(t) >= 40), key=len)[-1:]:
                    if text is None or len(new) > 1.05 * len(text):
                        expected[p["dblp_key"]] = new
    got = {r.dblp_key: r.abstract for r in catalogue.enriched(spark, str(tmp_path)).collect()}
    assert got == {k: t for k, t in expected.items() if t is not None}
    assert got["k0"] == words(30, "p") and got["k3"] == words(8, "p") and got["k9"] == words(40, "p")


def test_unknown_dimension_key_is_an_error(spark):
    joined = joins.with_dimension(table(spark, paper(1)), spark.createDataFrame([("w", 1)], "venue string, ord int"), "venue")
    with pytest.raises(Exception, match="unknown venue: v"):
        joined.select("dblp_key", "ord").collect()


def test_report_of_nothing_and_of_little(spark):
    venues = spark.createDataFrame([(0, "v", "Venue")], "ord int, slug string, name string")
    assert report.build(table(spark, paper(1)).limit(0), venues)["meta"]["total"] == 0
    t = table(spark, paper(1, title="Quantum graphs", authors=[("Ann", "1"), ("Bo", "")]), paper(2, key="l", year=2019, authors=[("Ann Lee", "1")]))
    got = report.build(t, venues)
    assert got["meta"] == {"total": 2, "editions": 2, "year_min": 2019, "year_max": 2020, "coverage": 1.0, "avg_labels": 1.5, "authors": 3}
    assert got["top_authors"][0]["name"] == "Ann Lee" and got["top_authors"][0]["n"] == 2
    assert len(got["topics"]) == 25 and got["bucket_total"] == {"2015-2019": 1, "2020-2024": 1}


def test_compact_and_shards(spark, tmp_path):
    venues = spark.createDataFrame([(0, "v", "Venue")], "ord int, slug string, name string")
    rows = [paper(i, key=f"k{i}", title=f"T{i}", year=2000 + i, authors=[("Ann", ""), (f"N{i}", "")]) for i in range(5)]
    c = report.compact(aggregates.labelled(table(spark, *rows)), venues)
    first = c.where("browse_idx = 0").first()
    assert first.title == "T4" and list(first.author_nos) == [0, 5] and list(first.topic_nos) == [24]
    texts = report.shards(c, spark.createDataFrame([("k4", "abs"), ("k0", "end")], "dblp_key string, abstract string"), size=2)
    assert {r.shard: list(r.texts) for r in texts.collect()} == {0: ["abs", ""], 1: ["", ""], 2: ["end"]}
    files.write_shards(texts, str(tmp_path / "s"))
    assert json.loads(next((tmp_path / "s" / "shard=0").glob("part*")).read_text()) == ["abs", ""]


def test_files(spark, tmp_path):
    t = table(spark, paper(1, title='He said "x", twice', authors=[("Ann; B", "1")]), paper(2, title="Zwei\nZeilen é", key="l"), paper(3, key=""))
    files.write_csv_file(files.flat(t), str(tmp_path / "a.csv"))
    raw = (tmp_path / "a.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfvenue,") and b'"He said ""x"", twice"' in raw and raw.endswith(b"\r\n")
    files.write_sqlite(t, str(tmp_path / "p.db"))
    files.write_sqlite(table(spark, paper(5, key="n", title="New")), str(tmp_path / "p.db"), replace_venues=["v"])
    with sqlite3.connect(tmp_path / "p.db") as db:
        assert db.execute("select dblp_key, title from papers").fetchall() == [("n", "New")]
        assert db.execute("select pid from authors").fetchall() == [("1",)]  # authors stay
    for _ in range(2):
        files.write_atomic(spark.createDataFrame([("b", "2"), ("a", "1")], "dblp_key string, abstract string"), str(tmp_path / "abs"), "dblp_key")
    assert [r.dblp_key for r in files.read_jsonl_keyed(spark, str(tmp_path / "abs")).orderBy("dblp_key").collect()] == ["a", "b"]
    assert files.read_jsonl_keyed(spark, str(tmp_path / "none")).count() == 0
    assert files.fill_template("<x>__SITE_DATA__</x>", {"a": "</x>"}) == '<x>{"a":"\\u003c/x>"}</x>'
    with pytest.raises(ValueError):
        files.fill_template("<x></x>", {})
    (tmp_path / "feed.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><summary>S</summary></entry></feed>')
    assert tuple(files.read_feed_entries(spark, str(tmp_path / "feed.xml")).first()) == ("http://arxiv.org/abs/1", "S")
    files.write_report({"a": 1}, str(tmp_path / "r.json"))
    assert files.read_json_document(spark, str(tmp_path / "r.json")).first().a == 1
    assert files.read_pages(spark, str(tmp_path / "r.json")).first().body == '{"a":1}'
    files.write_formats(t, str(tmp_path / "out"), "p", ("jsonl", "csv"), per_venue=True)
    assert (tmp_path / "out" / "by_venue" / "venue=v").exists()


def test_authors_field_in_all_shapes(spark):
    shapes = ['{"author":"A &amp; B"}', '{"author":{"@pid":"1","text":"C"}}', '{"author":[{"@pid":"2","text":"D"},"E",{"text":""}]}', "{}", None, "broken"]
    df = spark.createDataFrame([(s,) for s in shapes], "a string")
    got = [[(x.name, x.pid) for x in r[0]] for r in df.select(crawl.authors_of(F.col("a"))).collect()]
    assert got == [[("A &amp; B", "")], [("C", "1")], [("D", "2"), ("E", "")], [], [], []]


class Server:
    """Answers by script; counts what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, url, timeout, agent):
        self.asked.append(url)
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def client(server, tmp_path=None, **more):
    naps = []
    return http.Client(cache=str(tmp_path) if tmp_path else None, opener=server, sleep=naps.append, delay=0.0, **more), naps


def test_client_retries_throttles_and_caches(tmp_path):
    ok = (200, {"Content-Type": "text/plain; charset=latin-1"}, "é".encode("latin-1"))
    c, naps = client(Server((429, {"Retry-After": "7"}, b""), OSError("down"), ok), tmp_path)
    assert c.get("http://x", {"q": "a b"}) == "é" and naps[:2] == [7.0, 20.0]
    assert c.get("http://x", {"q": "a b"}) == "é" and c.counts == {"requests": 3, "retries": 2, "cached": 1}
    c.opener = Server((200, {}, b"new"))
    assert c.get("http://x?q=a+b", force=True) == "new" and c.get("http://x?q=a+b") == "new"
    with pytest.raises(http.FetchError):
        client(Server((404, {}, b"")))[0].get("http://y")
    slow, _ = client(Server(*[(503, {}, b"")] * 3), retries=2)
    with pytest.raises(http.FetchError):
        slow.get("http://z")


PAGES = {0: {"@total": "3", "hit": [{"info": {"title": "A &amp; B.", "key": "k1", "year": "2001", "authors": {"author": "X 0001"}}}, {"info": {"title": "Preface", "key": "k2"}}]},
         2: {"@total": "9", "hit": {"info": {"title": "C", "key": "k1", "year": "", "type": "Editorship"}}}}


def fake_open(url, timeout, agent):
    offset = int(url.split("&f=")[1].split("&")[0])
    if "broken" in url and offset:
        return 404, {}, b""
    return 200, {}, json.dumps({"result": {"hits": PAGES[offset]}}).encode()


def test_paged_source_to_papers(spark):
    spark.dataSource.register(http.PagedSource)
    raw = spark.read.format("lectern_pages").options(url="http://api", queries='["toc:a:","toc:broken:"]', opener="tests.test_operators:fake_open", delay="0", pageSize="2").load().cache()
    status = {r.query: (r.expected, r.fetched, r.complete) for r in crawl.status(raw).collect()}
    assert status == {"toc:a:": (3, 3, True), "toc:broken:": (3, 2, False)}
    pages = raw.where("body is not null and query = 'toc:a:'").select(F.lit("v").alias("venue"), F.lit("V").alias("venue_full"), F.lit("t").alias("toc_key"), F.lit(1999).alias("toc_year"), "offset", "body")
    got = crawl.parse_hits(pages).collect()
    assert [(r.title, r.year, r.authors[0].name, r.authors[0].raw_name) for r in got] == [("A & B", 2001, "X", "X 0001")]
    assert crawl.parse_hits(pages, True, True).count() == 2  # the second copy of k1 falls to the first


def test_options_keep_their_meaning_whatever_their_case(spark):
    """Spark lowers the keys of options: page size, pauses, age of the cache and agent must still be found."""
    http.register(spark)
    wanted = json.dumps(["a#12", "b#9!5", "c#5"])
    raw = spark.read.format("lectern_pages").options(url="http://api", queries=wanted, opener="lectern.sources.offline:paged", delay="0", pageSize="5").load()
    pages = sorted((r.query, r.offset, r.body is not None, r.requests, r.failed) for r in raw.collect())
    assert pages == [("a#12", 0, True, 1, 0), ("a#12", 5, True, 1, 0), ("a#12", 10, True, 1, 0), ("b#9!5", 0, True, 1, 0), ("b#9!5", 5, False, 1, 1), ("c#5", 0, True, 1, 0)]
    given = {"maxDelay": "9", "ttlDays": "2", "userAgent": "me"}
    for source in (http.PagedSource, http.UrlSource, http.LookupSource):
        made = http.client_of(source({k.lower(): v for k, v in given.items()}).reader(None).options)
        assert (made.longest, made.ttl_days, made.agent) == (9.0, 2.0, "me")


def test_range_treats_unknown_years_as_outside(spark):
    df = spark.createDataFrame([(None,), (0,), (1999,), (2005,)], "year int")
    assert [r.year for r in crawl.in_range(df, 1990, 2000).collect()] == [1999]
    assert crawl.in_range(df).count() == 4


def test_rules_are_data(spark):
    own = [("ring", "", "", r"\bring")]
    assert [r.topic for r in joins.rule_matches(table(spark, paper(1, title="Ringing")), "title", own).collect()] == ["ring"]
    assert dims.topic_ids(own) == ["ring", "other"]


def test_lookups_go_on_where_they_stopped(spark, tmp_path):
    """Answers are kept batch by batch; a second run asks for what is missing only."""
    given = {"opener": "lectern.sources.offline:lookup", "delay": 0}
    want = lambda n: spark.createDataFrame([(f"10.12/{i:04d}",) for i in range(n)], "doi string")
    from lectern.sources import lookup

    first = lookup.fetch(spark, want(120), "doi", "doi", "https://w.example", str(tmp_path / "a"), given, group=1)
    assert first.count() == 3 and lookup.counters(first).first().requests == 3
    again = lookup.fetch(spark, want(170), "doi", "doi", "https://w.example", str(tmp_path / "a"), given)
    assert again.count() == 4 and lookup.works_of(again).select("doi").distinct().count() == 170
    assert lookup.fetch(spark, want(0), "doi", "doi", "https://w.example", str(tmp_path / "b"), given).count() == 0


def slow_open(url, timeout, agent):
    import time

    with open(url.split("#")[0].removeprefix("http://"), "a") as f:
        f.write(f"{time.monotonic()}\n")
    return 200, {}, b"{}"


def test_one_client_keeps_the_pause(spark, tmp_path):
    """However many cores there are, no two requests of a source lie within its delay."""
    http.register(spark)
    urls = json.dumps([f"http://{tmp_path}/log#{i}" for i in range(6)])
    spark.read.format("lectern_urls").options(urls=urls, delay="0.2", opener="tests.test_operators:slow_open").load().collect()
    at = [float(x) for x in (tmp_path / "log").read_text().split()]
    assert len(at) == 6 and min(b - a for a, b in zip(at, at[1:], strict=False)) >= 0.19


def test_gzip_and_charset(spark):
    import gzip

    client = http.Client(delay=0, opener=lambda *a: (200, {"Content-Encoding": "gzip", "Content-Type": "text/html; charset=latin-1"}, gzip.compress("é".encode("latin-1"))))
    assert client.get("http://x") == "é"


def test_the_last_line_wins_over_several_files(spark, tmp_path):
    """A small old file and a larger new one, which is read first."""
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "part-0.json").write_text('{"dblp_key":"a","abstract":"old"}\n\n{"dblp_key":"b","abstract":"b"}\n')
    (tmp_path / "k" / "part-1.json").write_text("".join(f'{{"dblp_key":"a","abstract":"new {i}"}}\n' for i in range(5000)))
    got = {r.dblp_key: r.abstract for r in files.read_jsonl_keyed(spark, str(tmp_path / "k")).collect()}
    assert got == {"a": "new 4999", "b": "b"}


def test_a_later_work_without_text_leaves_the_earlier_one(spark):
    works = spark.createDataFrame([(1, "10.1/a", "text", None), (2, "https://doi.org/10.1/A", None, "2301.00001"), (3, "10.1/a", None, None)], "work_id bigint, doi string, t string, a string")
    got = joins.texts_by_doi(table(spark, paper(1, doi="10.1/A"), paper(2, key="l", doi="10.1/a")), works, F.col("t"), F.col("a")).collect()
    assert [tuple(r) for r in got] == [("l", "text", "2301.00001")]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")
def test_last_wins_reads_what_is_used(spark):
    plan = catalogue.count_by_venue_year(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert sorted(c.split(":")[0] for c in read.removeprefix("struct<").rstrip(">").split(",")) == ["dblp_key", "row_idx", "venue", "year"]
    assert "Sort" not in plan


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from lectern import session

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_dir(Cluster)


def test_command_line_from_index_to_publication(spark, tmp_path, capsys):
    from lectern import cli

    d = str(tmp_path)
    venues = "ord int, slug string, name string, dblp_dir string, toc_prefix string, first_year int, note string"
    spark.createDataFrame([(0, "v", "Venue", "conf/v", "v", 1990, None), (1, "w", "Other", "conf/w", "w", 1991, "late")], venues).write.parquet(f"{d}/venues")
    run = lambda *args: cli.main(list(args), spark)
    crawl_args = ["crawl", "--venues-table", f"{d}/venues", "--index-url", "http://i/{}", "--url", "http://s/api", "--opener", "lectern.sources.offline:index", "--delay", "0", "-o", f"{d}/out"]
    assert run(*crawl_args, "--formats", "jsonl", "csv", "sqlite", "--per-venue", "--since", "2000", "--cache-dir", f"{d}/cache") == 0
    said = capsys.readouterr()
    assert "TOTAL\t6" in said.out and "requests=2" in said.err
    raw = Path(f"{d}/out/papers.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfvenue,year,title") and raw.count(b"\r\n") == 7
    assert run(*crawl_args, "-v", "nowhere") == 2 and run(*crawl_args, "--list-venues") == 0
    assert "w\tOther\t1991\tlate" in capsys.readouterr().out
    papers = files.read_jsonl(spark, f"{d}/out/papers.jsonl").withColumn("doi", F.concat(F.lit("10.12/"), F.length("dblp_key").cast("string"), F.right("dblp_key", F.lit(1))))
    papers.withColumn("row_idx", F.monotonically_increasing_id()).write.parquet(f"{d}/papers")
    enrich_args = ["enrich", "--papers", f"{d}/papers", "-o", f"{d}/abstracts"]
    assert run(*enrich_args) == 2
    assert run(*enrich_args, "--url", "http://w/api", "--answers", f"{d}/answers", "--opener", "lectern.sources.offline:lookup", "--title-delay", "0", "--mailto", "a@b.example") == 0
    assert Path(f"{d}/abstracts").exists()  # the made-up texts are too short to be kept
    assert run("analyze", "--papers", f"{d}/papers", "--venues-table", f"{d}/venues", "-o", f"{d}/report.json") == 0
    assert json.loads(Path(f"{d}/report.json").read_text())["meta"]["total"] == 6
    Path(f"{d}/page.html").write_text("<script>__SITE_DATA__</script>")
    args = ["publish", "--report", f"{d}/report.json", "--template", f"{d}/page.html", "--papers", f"{d}/papers", "--venues-table", f"{d}/venues", "--abstracts", f"{d}/none", "-o", f"{d}/index.html", "--shards", f"{d}/shards"]
    assert run(*args) == 0 and '"total":6' in Path(f"{d}/index.html").read_text() and Path(f"{d}/shards").exists()
