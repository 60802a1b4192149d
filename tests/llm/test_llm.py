"""Training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import bisect
import itertools
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import session
from lectern.llm import leakage, matching, packing, plainform, residue, subjects, terms, truncation

quick = settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

# --- 1 terms --------------------------------------------------------------------------------------------------------


def brute_counts(texts):
    occurrences, records = Counter(), Counter()
    for t in texts:
        found = re.findall(r"[a-z][a-z\-']{2,}", (t or "").lower())
        occurrences.update(found)
        records.update(set(found))
    return {(t, occurrences[t], records[t]) for t in occurrences}


@quick
@given(st.lists(st.one_of(st.none(), st.text("abc -'A", max_size=30)), max_size=8))
def test_term_counts_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, term string")
    assert {tuple(r) for r in terms.term_counts(df, F.col("text")).collect()} == brute_counts(texts)


def test_marks_and_valid_rows(spark):
    rows = [("a", 1, "old words"), ("a", 3, "graph graph"), ("b", 2, "graph"), ("c", 4, None), (None, 5, "lost"), ("d", 6, "")]
    valid = terms.valid_rows(spark.createDataFrame(rows, "key string, n int, text string"), "key", "n", "text")
    assert {tuple(r) for r in valid.collect()} == {("a", "graph graph"), ("b", "graph"), ("c", None), ("d", "")}
    counts = spark.createDataFrame([("x", 2, 2), ("y", 9, 6), ("z", 9, 5), ("w", 3, 3)], "term string, occurrences bigint, records bigint")
    assert {r.term: r.mark for r in terms.mark_terms(counts, 100).collect()} == {"x": "rare", "y": "common", "z": None, "w": None}
    assert terms.term_counts(valid.limit(0), F.col("text")).count() == 0


# --- 2 plain form ---------------------------------------------------------------------------------------------------

PLAIN = ["Near-linear graphs in O(n²) Steps", "π-Anna Šolpi", "Мария Иванова", "Θηψυδω Ψησ", "naïve – the Adversary’s Choice", "惨峿", "Õ(n) Time", "", "α-paths"]
ODD = {
    "Ｇｒａｐｈｓ　ａｎｄ": "Graphs and", "grаphs of cоde": "graphs of code", "Αn approaϲh": "An approach", "zero\u200bwidth\u00ad \ufeffhere": "zerowidth here",
    "no\u00a0break\u2007space": "no break space", "of\ufb02ine": "offline", "Hiri\u0308lm": "Hirïlm", "word‐level": "word-level", "\u200b": "", "Соре Rule of graphs": "Cope Rule of graphs",
    "Grⲟups of codes": "Groups of codes", "ꓖraphs and codes": "Graphs and codes", "ɪndex of graphs": "index of graphs", "a cჿde": "a code",
}


def test_plain_form(spark):
    corpus = [*PLAIN, "graphs of code and approach near linear offline rule cope paths graph codes"] * 5
    df = spark.createDataFrame([(t, "x") for t in [*corpus, *ODD, None]], "value string, plain string")
    scores = plainform.fit_letter_pairs(df.select("value"))
    got = {r[0]: r[1] for r in df.select("value", plainform.plain_form("value", scores).alias("p")).collect()}
    assert {t: got[t] for t in PLAIN} == {t: t for t in PLAIN}
    assert {t: got[t] for t in ODD} == ODD
    assert got[None] is None
    assert df.limit(0).select(plainform.plain_form("value", scores)).count() == 0
    long = "grаph " * 20_000
    assert plainform.plain_text(long, scores) == "graph " * 20_000


def test_letter_pairs_equal_brute_force():
    texts = ["ab ba", "аб", "Ab"]
    counts = plainform._pairs(texts)
    n = plainform._number
    brute = Counter()
    joined = "\n" + "\n".join(texts) + "\n"
    for a, b in zip(joined, joined[1:], strict=False):
        brute[n(a) * plainform.N_LETTERS + n(b)] += 1
    assert {i: int(counts[i]) for i in np.flatnonzero(counts)} == brute


# --- 3 truncation ---------------------------------------------------------------------------------------------------

SUBJECTS = ["graphs", "codes", "auctions", "trees", "heaps", "lattices", "games", "strings"]
SENTENCES = [
    "We study {0} in the online setting and give the first bounds that depend only on the size of the {1}", "The proof combines {0} with a new view of {1} that may be of independent interest",
    "Our main result is an algorithm for {0} that runs in linear time and uses {1}", "Previous work on {0} needed {1} and the resulting cost was far from what is possible",
    "We hope that the ideas presented here will be useful to others as well", "Experiments on many instances suggest that {0} are close to optimal for {1}",
]


def abstract(rng, n=6):
    return " ".join(rng.choice(SENTENCES).format(rng.choice(SUBJECTS), rng.choice(SUBJECTS)) + "." for _ in range(n))


@pytest.fixture(scope="module")
def cut_table(spark):
    rng = random.Random(5)
    rows, truth = [], set()
    for i in range(300):
        text = abstract(rng)
        rows.append((len(rows), "whole", text))
        if i % 3 == 0:
            rows.append((len(rows), "bare", text[:-1]))  # this source leaves out the last full stop
        if i % 4 == 0:
            truth.add(len(rows))
            rows.append((len(rows), "short", text[:200].rstrip() if text[199] not in ". " else text[:205]))
        if i % 50 == 0:
            truth.add(len(rows))
            rows.append((len(rows), "whole", text[:150] + rng.choice(["...", " [truncated]", "�", " (…)"])))
    rows += [(len(rows), None, None), (len(rows) + 1, "whole", ""), (len(rows) + 2, "whole", "We list games, codes and so on...")]
    return spark.createDataFrame(rows, "id bigint, source string, text string"), truth


def test_cut_texts(spark, cut_table):
    df, truth = cut_table
    got = {r.id for r in truncation.mark_cut(df, "id", "source", "text").where("is_cut").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    shares = {r.source: r.n_rows for r in truncation.share_by_source(truncation.mark_cut(df, "id", "source", "text"), "source").collect()}
    assert sum(shares.values()) == df.count()
    assert truncation.mark_cut(df.limit(0), "id", "source", "text").count() == 0


def test_endings_and_alignment():
    assert [truncation.ending(t) for t in (None, " ", "It ends.", "It en...", "and so on...", "It en", "Done. Keywords: a, b", "Done. (Joint session)", "half &am", 'the "x."')] == [
        "blank", "blank", "whole", "mark", "whole", "open", "whole", "whole", "mark", "whole",
    ]
    full = "We study graphs in the online setting. The proof combines codes with a view of games."
    assert truncation.follow("We study graphs in the onl", full) == (1.0, True)
    assert truncation.follow("We study graphs in the online setting", full) == (1.0, False)
    assert truncation.follow("We study graphs in the online setting. The proof combines codes with", full)[1]
    assert truncation.follow("Something else altogether was said here", full)[0] < 0.8


def test_structured_abstracts_can_be_cut():
    """A label and a colon make no text whole; a list of keywords does."""
    for t in ("Background: graphs are old. Results: We show that the new bound is bet", "Our result: we give a bound. We then extend it to digraphs and pro", "See Jones et al.", "We use codes, e.g."):
        assert truncation.ending(t) == "open"
    for t in ("A bound. Keywords: graphs, codes", "A bound.\nMSC 2010: 68W90, 05C12", "A bound. Code: https://code.example/x", "A bound. (Joint session)"):
        assert truncation.ending(t) == "whole"


def test_structured_abstracts_are_looked_up(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        say = lambda n: " ".join("We " + " ".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(9)) + " graphs." for _ in range(n))
        text = "Background: " + say(3) + " Results: " + say(3)
        rows += [(3 * i, "a", text), (3 * i + 1, "b", text[: text.index("Results: ") + 40].rstrip() + "x"), (3 * i + 2, "c", text + " Keywords: graphs, codes")]
    got = {r.id for r in truncation.mark_cut(spark.createDataFrame(rows, "id bigint, source string, text string"), "id", "source", "text").where("is_cut").collect()}
    assert got == {3 * i + 1 for i in range(40)}


def changed_words(rng, words, share):
    return [f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("share", "least"), [(0.0, 1.0), (0.02, 0.97), (0.05, 0.9)])
def test_bands_find_openings(share, least):
    """Share of openings that meet their whole text, by the share of changed words."""
    rng = random.Random(1)
    texts = [[f"v{rng.randrange(3000)}" for _ in range(rng.randint(60, 220))] for _ in range(400)]
    parts = [changed_words(rng, w[: rng.randint(30, len(w))], share) for w in texts]
    keys = [set() for _ in texts]
    for owner, _, key in zip(*(x.tolist() for x in truncation.ladder_bands(texts, False)), strict=True):
        keys[owner].add(key)
    asked = [set() for _ in texts]
    for owner, _, key in zip(*(x.tolist() for x in truncation.ladder_bands(parts, True)), strict=True):
        asked[owner].add(key)
    assert sum(len(a & b) >= truncation.MEET for a, b in zip(asked, keys, strict=True)) >= least * len(texts)
    assert not any(a & b for a, b in zip(asked[1:], keys, strict=False))
    # one text by itself has the bands that it has among others
    alone = truncation.ladder_bands(texts[7:8], False)[2]
    assert set(alone.tolist()) == keys[7]
    assert len(truncation.ladder_bands([[], ["a"] * 5], False)[2]) == 0


def test_a_shared_opening_is_one_offer(spark):
    """Very many texts of one opening: those who ask get the vote of all of them, and one alignment for each view."""
    rng = random.Random(3)
    opening = abstract(rng, 4)
    rows = [(i, "a", opening + " " + abstract(rng, 8)) for i in range(60)]
    rows += [(100 + i, "b", opening[: 120 + 7 * i].rstrip(" .") + "q") for i in range(5)]
    got = {r.id: r.reason for r in truncation.mark_cut(spark.createDataFrame(rows, "id bigint, source string, text string"), "id", "source", "text").where("is_cut").collect()}
    assert got == {100 + i: "copy" for i in range(5)}


def test_slices_see_all_bands_and_all_pairs(spark, cut_table, monkeypatch):
    """Looked up in slices of the bands and aligned in slices of the copies, every row has the verdict that it has in one go."""
    df, _ = cut_table
    rows = lambda: sorted(tuple(r) for r in truncation.mark_cut(df, "id", "source", "text").collect())
    whole = rows()
    monkeypatch.setattr(truncation, "SLICED", 0)
    assert rows() == whole
    monkeypatch.setattr(truncation, "ASKED", 1 << 16)  # a table that holds a few bands of the texts that ask
    monkeypatch.setattr(truncation, "ROOM", 64)
    assert rows() == whole
    texts = [[f"v{(i * 7 + j) % 50}" for j in range(40)] for i in range(5)]
    every = set(zip(*(x.tolist() for x in truncation.ladder_bands(texts, False)), strict=True))
    parts = [set(zip(*(x.tolist() for x in truncation.ladder_bands(texts, False, some)), strict=True)) for some in (range(9), range(9, 26))]
    assert parts[0] | parts[1] == every and not parts[0] & parts[1]


def test_tables_of_texts_go_when_they_are_used_up(spark, cut_table):
    """Of all scratch tables only the facts on the endings and the votes are there when the verdicts are read."""
    df, _ = cut_table
    folder = Path(session.scratch_dir(spark))
    tables = lambda: {p.name.split("-")[1] for p in folder.iterdir() if p not in there}
    there = set(folder.iterdir())
    kept = session.cut(df, "kept", lean=True)
    marked = truncation.mark_cut(kept, "id", "source", "text", spent=kept)
    assert tables() == {"facts", "steps"}
    assert marked.count() == df.count()


def test_what_a_lean_cut_shuffled_goes_with_it(spark):
    store = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in store.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    there = files()
    out = session.cut(spark.range(1000).repartition(4, "id"), "lean", lean=True)
    end = time.monotonic() + 20
    while files() - there and time.monotonic() < end:
        time.sleep(0.1)
    assert not files() - there and out.count() == 1000


# --- 4 residue ------------------------------------------------------------------------------------------------------


def test_residue(spark):
    clean = ["We study $f:\\{0,1\\}^n \\to \\{-1,1\\}$ with ${n \\choose k}$ parameters.", "Of 90 requests 404 were answered late and a page was not found in the cache.",
             "Scripts that run in a browser are a model for clients.", "the set {x_i : i < k} and [TODO-free] proofs", "We call a session expired if access was denied."] * 20
    bad = ["Please enable JavaScript to view this page.", "We study {{ title }} graphs in depth.", "404 Not Found. The requested record 12 could not be located on this server",
           "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "TODO: write the abstract.", "xxxx xxxxx xxx xxxx", "test test test test test test", "[object Object]",
           "A proof. Page %1$s of %2$s", "请启用 JavaScript 后重新加载本页面，以便查看摘要内容。"]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate([*clean, *bad, None, "", "graph " * 10 + "games " * 3 + "x " * 50_000])], "id int, text string, score double")
    index = residue.fit_residue_index(df, "text")
    got = {r.id for r in residue.residue_rows(df, "text", index).collect()}
    assert got - {len(clean) + len(bad) + 2} == set(range(len(clean), len(clean) + len(bad)))
    assert residue.without_residue(df, "text", index).count() + len(got) == df.count()
    assert residue.residue_rows(df.limit(0), "text", residue.fit_residue_index(df.limit(0), "text")).count() == 0


def test_exemplars_are_a_table(spark):
    """Other exemplars find other texts; wrong labels and too many rows are errors; no exemplars find nothing."""
    df = spark.createDataFrame([(0, "The kettle is on strike, call the porter"), (1, "Please enable JavaScript to view this page."), (2, "Words {{ name }} words")], "id int, text string")
    schema = "family string, label string, text string"
    own = lambda *rows: residue.fit_residue_index(df, "text", spark.createDataFrame(list(rows), schema))
    ids = lambda index: {r.id for r in residue.residue_rows(df, "text", index).collect()}
    assert ids(own(("k", "error", "kettle on strike"))) == {0} and ids(own(("k", "template", "{{ title }}"))) == {2} and ids(own()) == set()
    with pytest.raises(ValueError):
        own(("k", "nonsense", "x"))


def test_notices_in_other_words(spark):
    """Notices that are worded as no exemplar is, in several languages, and earnest sentences of the same words."""
    index = residue.fit_residue_index(spark.createDataFrame([("A plain abstract of graphs on a page of a site.",)] * 20, "text string"), "text")
    for t in ("Vous devez activer JavaScript pour lire ce résumé.", "JavaScript ist in Ihrem Browser deaktiviert.", "Abilitare JavaScript nelle impostazioni del browser per proseguire.",
              "For full functionality of this site it is necessary to enable JavaScript.", "Error 503: the service is unavailable. Please try again later.", "See {{link}}.", "Dear ${user.name}", "lorem ipsum amet dolor"):
        assert index.score(t)[0] >= 1, t
    for t in ("We study scripts that a browser may require.", "A server that is temporarily slow answers 404 requests later.", "Keywords: radio networks, radio networks, radio networks", "sets {x_i : i < k} and log log log n"):
        assert index.score(t)[0] < 1, t


# --- 5 matching -----------------------------------------------------------------------------------------------------


def test_matching(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    left, right, truth = [], [], set()
    for i in range(150):
        title = " ".join([word().title() for _ in range(3)] + ["Graphs and", word(), "Codes"])
        left.append((f"k{i}", title, 2000 + i % 20, f"10.1234/a.{i}", "x"))
        kind = i % 6
        if kind == 5:
            right.append((i, f"Erratum to {title}", 2001 + i % 20, "", "y"))
            continue
        noisy = [title.lower(), title + " (extended abstract)", title.replace("Codes", "Cdoes"), title.replace("Graphs and ", ""), title[: len(title) - 9] + "…"][kind]
        truth.add((f"k{i}", str(i)))
        right.append((i, noisy, None if i % 7 == 0 else 2000 + i % 20, f"https://doi.example/10.1234/A.{i}." if i % 2 else None, "y"))
    left += [(f"f{i}", "Front Matter", 2000 + i, f"10.1/f{i}", "x") for i in range(5)] + [("e", "", 2000, "10.9999/e", "x"), ("n", None, None, None, "x")]
    right += [(900, "Front matter", 2000, None, "y"), (901, "Front matter", 2003, "10.1/f3", "y"), (902, None, 2001, "10.9999/E", "y"), (903, None, None, None, "y")]
    a = spark.createDataFrame(left, "key string, title string, year int, doi string, id string")
    b = spark.createDataFrame(right, "work bigint, name string, y int, doi string, id string")
    roles = ("key", "title", "year", "doi"), ("work", "name", "y", "doi")
    got = matching.assign(matching.match_pairs(a, b, *roles)).collect()
    pairs = {(r.left_id, r.right_id) for r in got}
    # a DOI of fewer than four digits after 10. is none
    assert pairs - {("e", "902")} <= truth and len(pairs & truth) >= 0.98 * len(truth) and ("e", "902") in pairs
    assert len({r.right_id for r in got}) == len(got) and all(0 < r.confidence <= 1 for r in got)
    assert matching.match_pairs(a.limit(0), b.limit(0), *roles).count() == 0


def test_windows_meet_across_partitions(spark):
    """Every pair within the window is compared, wherever the partitions end."""
    a = spark.createDataFrame([(f"{i:04d}", f"Same Opening Words Then {chr(97 + i % 26)}{i:04d}x", 2000, "") for i in range(300)], "k string, t string, y int, d string")
    pairs = matching.match_pairs(a, a.select(F.col("k").cast("bigint").alias("k"), "t", "y", "d"), ("k", "t", "y", "d"), ("k", "t", "y", "d"), window=3)
    same = {r.left_id for r in pairs.where("cast(left_id as bigint) = cast(right_id as bigint)").collect()}
    assert len(same) == 300


def test_equal_records_are_no_matter_of_the_window(spark):
    """Repeated works, works of one title and works of one DOI all meet, however many there are; held against all pairs."""
    left = [("k1", "Sparse Graphs and Random Codes", 2000, "10.1234/a"), ("k2", "Dense Lattices under Noise", 2001, None)]
    left += [(f"f{i}", "Front Matter", 2000 + i, f"10.1234/f{i}") for i in range(4)]
    right = [(i, "Sparse Graphs and Random Codes", 2000, "10.1234/a") for i in range(40)]
    right += [(100 + i, "Sparse Graphs and Random Codse", 1990 + i, f"10.5678/x{i}") for i in range(40)]
    right += [(200 + i, "Dense Lattices under Noise", 2001, f"10.5678/y{i}") for i in range(40)]
    right += [(300 + i, "Front matter", 1980 + i, "10.1234/f2") for i in range(40)] + [(400, "Front matter", 2000, None)]
    a = spark.createDataFrame(left, "k string, t string, y int, d string")
    b = spark.createDataFrame(right, "k bigint, t string, y int, d string")
    roles = ("k", "t", "y", "d")
    record = lambda t, y, d: matching.Record(" ".join(matching.title_tokens(t)), y, d or "", False, t == "Front Matter")
    brute = {(lk, str(rk)): matching.score_pair(record(*l), record(*r)) for lk, *l in left for rk, *r in right}
    brute = {pair: s for pair, s in brute.items() if s >= matching.BOUND}
    got = {(r.left_id, r.right_id): r.confidence for r in matching.match_pairs(a, b, roles, roles).collect()}
    assert len(brute) > 150 and got == pytest.approx(brute)
    best = {tuple(r) for r in matching.best_matches(a, b, roles, roles).collect()}
    assert best == {tuple(r) for r in matching.assign(matching.match_pairs(a, b, roles, roles)).collect()}


ROLES = ("k", "t", "y", "d")


def test_heaviest_equals_all_permutations():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = (int(x) for x in rng.integers(1, 5, size=2))
        w = np.where(rng.random((n, m)) < 0.6, rng.integers(1, 20, (n, m)), 0) / 10
        wide = np.concatenate([w, np.zeros((n, n))], axis=1)
        best = max(sum(wide[i, c[i]] for i in range(n)) for c in itertools.permutations(range(m + n), n))
        got = matching.heaviest(w)
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) and sum(w[p] for p in got) == pytest.approx(best)


@pytest.mark.parametrize("part", [matching.PART, 0])
def test_assignment_is_one_to_one_first(spark, monkeypatch, part):
    """In one task and by the auction: the largest total in round one, further versions in the rounds after it."""
    monkeypatch.setattr(matching, "PART", part)
    monkeypatch.setattr(matching, "STEP", 0.04)
    schema = "left_id string, right_id string, confidence double"
    given = [("P1", "W1", 0.9), ("P1", "W2", 0.95), ("P2", "W2", 0.8), ("P3", "W3", 0.8), ("P3", "W4", 0.9), ("P4", "W5", 0.75), ("P5", "W5", 0.75)]
    got = {(r.left_id, r.right_id) for r in matching.assign(spark.createDataFrame(given, schema)).collect()}
    assert got - {("P5", "W5")} in ({("P1", "W1"), ("P2", "W2"), ("P3", "W3"), ("P3", "W4"), ("P4", "W5")}, {("P1", "W1"), ("P2", "W2"), ("P3", "W3"), ("P3", "W4")}) and len(got) == 5
    rng = random.Random(4)
    n = 12 if part else 5
    pairs = {(f"l{rng.randrange(n)}", f"r{rng.randrange(n + 1)}"): rng.randint(70, 100) / 100 for _ in range(3 * n)}
    rows = [(*k, v) for k, v in pairs.items()]
    got = matching.assign(spark.createDataFrame(rows, schema)).collect()
    assert {r.right_id for r in got} == {r for _, r in pairs} and len(got) == len({r for _, r in pairs})
    lefts, rights = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    w = np.array([[pairs.get((a, b), 0.0) for b in rights] for a in lefts])
    best = sum(w[p] for p in matching.heaviest(w))
    own = {}
    for r in got:
        own[r.left_id] = max(own.get(r.left_id, 0), pairs[r.left_id, r.right_id])
    assert sum(own.values()) >= best - (0 if part else 0.04 * len(lefts)) - 1e-9
    assert matching.assign(spark.createDataFrame([], schema)).count() == 0


def test_one_title_in_three_decades(spark):
    """Years tell records of one title apart; for front matter and titles of very many they do not."""
    left = [(f"k{y}", "A Note on Sparse Codes", y, None) for y in (1980, 1995, 2010)] + [(f"m{y}", "Sampling Trees Fast", 1980 + y, None) for y in range(6)]
    left += [(f"f{y}", "Invited Talk: Program Committee", y, None) for y in (1990, 2000)] + [("s1", "Twin Paper on Codes", 2001, None), ("s2", "Twin Paper on Codes", 2001, None)]
    right = [(i, t, y, d) for i, (_, t, y, d) in enumerate(left)]
    rows = matching.best_matches(spark.createDataFrame(left, "k string, t string, y int, d string"), spark.createDataFrame(right, "k bigint, t string, y int, d string"), ROLES, ROLES).collect()
    assert {(r.left_id, r.right_id) for r in rows} == {("k1980", "0"), ("k1995", "1"), ("k2010", "2"), ("s1", "11"), ("s2", "12")}


@pytest.mark.parametrize("chunk", [matching.CHUNK, 7])
def test_no_alike_title_is_lost_by_the_window(spark, monkeypatch, chunk):
    """Works whose paper is far away in every order: a cut title without an early word, slips in two words, short titles."""
    monkeypatch.setattr(matching, "CHUNK", chunk)
    full = ["Explicit Qubit Registers via Gate Teleportation: From Spectral Gap of the Hamiltonian to Magic States", "Robust Sekli for Expander Codes via Information Cost Arguments", "Beyond Klousand"]
    left = [(f"k{i}", t, 2001, None) for i, t in enumerate(full)]
    # in each of the orders some of these stand between
    between = ["Explicit Registers via Gate Teleportation: From Spa{}", "Spf{}", "Teleportation Kingdoms{} Codes", "Explicit R{}", "Robv{}", "Arh{} Cost", "Arguz{} Codes", "Information Arr{}", "Rlst{}", "Klov{} Bb{}", "Bb{} Klov{}", "Bynd Klt{}"]
    left += [(f"{t}{i}", t.replace("{}", f"{i:02d}"), 2001, None) for t in between for i in range(4)]
    left += [(f"b{i}", f"Roust Qu{i:02d}li for Expander Codes via Information Cost Arrguments", 2001, None) for i in range(4)]
    right = [(0, "Explicit Registers via Gate Teleportation: From Spe...", 2001, None), (1, "Roust Sekli for Expander Codes via Information Cost Arrguments", 2001, None), (2, "Bayond Klowsand", 2001, None)]
    a = spark.createDataFrame(left, "k string, t string, y int, d string")
    b = spark.createDataFrame(right, "k bigint, t string, y int, d string")
    got = {(r.left_id, r.right_id) for r in matching.match_pairs(a, b, ROLES, ROLES, window=1).collect()}
    record = lambda t, m=False: matching.Record(" ".join(matching.title_tokens(t)), 2001, "", m, False)
    assert got == {(k, str(n)) for k, t, *_ in left for n, u, *_ in right if matching.score_pair(record(t), record(u, u.endswith("..."))) >= matching.BOUND}
    assert {("k0", "0"), ("k1", "1"), ("k2", "2")} <= got


def test_a_frequent_doi_is_dealt_out_whole(spark, monkeypatch):
    monkeypatch.setattr(matching, "PAIRS", 10)
    a = spark.createDataFrame([(f"k{i}", f"Part {i}", 2000, "10.1234/a") for i in range(6)], "k string, t string, y int, d string")
    b = spark.createDataFrame([(i, "", 1999 + i % 3, "10.1234/a") for i in range(3)] + [(9 + i, f"Part {i}", 2000, "10.1234/A") for i in range(30)], "k bigint, t string, y int, d string")
    pairs = matching.match_pairs(a, b, ("k", "t", "y", "d"), ("k", "t", "y", "d")).collect()
    assert len(pairs) == len({(r.left_id, r.right_id) for r in pairs})
    assert {(f"k{i}", str(n)) for i in range(6) for n in (0, 1, 2, 9 + i)} <= {(r.left_id, r.right_id) for r in pairs}


# --- 6 packing ------------------------------------------------------------------------------------------------------


def best_fit(sizes, capacity):
    gaps, n = [], sum(s // capacity for s in sizes if s > capacity)
    for s in sorted((s if s <= capacity else s % capacity for s in sizes), reverse=True):
        if not s:
            continue
        i = bisect.bisect_left(gaps, s)
        g = gaps.pop(i) if i < len(gaps) else capacity
        n += g == capacity and i >= len(gaps) + (g != capacity)
        if g > s:
            bisect.insort(gaps, g - s)
    return n


@pytest.mark.parametrize("sizes", [[], [0, 0], [5], [10, 10, 10], [3] * 50 + [7] * 20 + [25, 31, 100], list(range(1, 40))])
def test_packing_is_whole(spark, sizes):
    items = spark.createDataFrame([(i, s, "c") for i, s in enumerate(sizes)], "id bigint, size int, container string")
    packs = spark.createDataFrame([("a", 10), ("b", 33)], "pack string, room int")
    rows = packing.pack(items, "id", "size", packs, "pack", "room").collect()
    for pack, room in (("a", 10), ("b", 33)):
        own = [r for r in rows if r["pack"] == pack]
        totals, loads = Counter(), Counter()
        for r in own:
            totals[r.id] += r.tokens
            loads[r.container] += r.tokens
        assert dict(totals) == {i: s for i, s in enumerate(sizes)}
        assert all(n <= room for n in loads.values())
        assert all(len([r for r in own if r.id == i]) == 1 for i, s in enumerate(sizes) if s <= room)
        used = sorted(c for c in loads if c)
        assert used == list(range(1, len(used) + 1))


@quick
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(16, 64))
def test_plan_is_close_to_best_fit(sizes, capacity):
    sizes = [min(s, capacity) for s in sizes]
    have = Counter(sizes)
    keys = sorted(have)
    runs = packing.plan(np.array(keys, dtype=np.int64), np.array([have[k] for k in keys], dtype=np.int64), capacity)
    load, placed = Counter(), Counter()
    for s, low, n, first in runs:
        assert placed[s] == low
        placed[s] += n
        for c in range(first, first + n):
            load[c] += s
    assert placed == have and all(v <= capacity for v in load.values())
    assert len(load) <= -(-sum(sizes) // capacity) * 1.25 + 2


def test_a_size_in_many_buckets_is_placed_once(spark):
    """One size holds most texts: each rank is used once, so each container holds what the plan gives it."""
    items = spark.range(4000).select("id", F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id") % 97).alias("size"))
    packs = spark.createDataFrame([(None, 40)], "pack string, room int")
    rows = packing.pack(items, "id", "size", packs, "pack", "room").collect()
    loads = Counter()
    for r in rows:
        loads[r.container] += r.tokens
    assert sum(loads.values()) == sum(7 if i % 4 else i % 97 for i in range(4000)) and all(n <= 40 for n in loads.values())
    assert Counter(r.id for r in rows) == Counter({i: 1 if i % 4 or i % 97 <= 40 else -(-(i % 97) // 40) for i in range(4000)})
    assert packing.pack(items, "id", "size", packs.limit(0), "pack", "room").count() == 0


def test_bad_capacity_and_token_counts(spark):
    packs = spark.createDataFrame([(1, 0)], "p int, c int")
    with pytest.raises(ValueError):
        packing.pack(spark.range(1).withColumn("size", F.lit(1)), "id", "size", packs, "p", "c")
    tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, " \n"), (4, "")], "id int, t string")
    got = {r.id: r.tokens for r in packing.count_tokens(df, "id", "t", tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 0}


# --- 7 leakage ------------------------------------------------------------------------------------------------------


def leak_table(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    form = "In the town of {} exactly {} clerks sort {} graphs by hand and record the {} in a ledger of {} pages"
    say = lambda: form.format(word().title(), rng.randint(2, 99), rng.randint(2, 99), word(), rng.randint(2, 99))
    items = [(i, "Answer in one word. " + ". ".join(say() for _ in range(3)) + f". What did {word()} say?") for i in range(20)]
    docs, truth = [], set()
    for d in range(200):
        sentences = [abstract(rng, 1) for _ in range(5)] + [say() + "."]  # built alike, yet another sentence
        if d % 4 == 0:
            i = rng.randrange(20)
            s = leakage.BREAK.split(items[i][1])[1 + rng.randrange(3)].split()
            for _ in range(rng.randint(0, 2)):
                s[rng.randrange(len(s))] = "other"
            text = " ".join(s).upper() if d % 8 else "\n".join(s).replace(",", "")
            sentences.insert(rng.randrange(5), text)
            truth.add((d, i))
        docs.append((d, " ".join(sentences)))
    return [*docs, (900, None), (901, ""), (902, "What did anyone say? Answer in one word.")], items, truth


def test_leaks_equal_what_was_planted(spark):
    docs, items, truth = leak_table()
    d = spark.createDataFrame([(a, b, 7) for a, b in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == truth
    assert leakage.find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_items_with_one_passage_leak_each(spark):
    """Repeated items and items of one passage keep their sentences; instruction lines stay out."""
    docs, items, truth = leak_table()
    line = "Read all of the passage before you give one answer. "
    items = [(i, line + t if i % 2 else t) for i, t in items]
    more = [(100 + i, t) for i, t in items] + items[:5]
    more += [(200 + i, t[: t.rindex(". ") + 2] + f"Why did {i} of them say nothing?") for i, t in items]
    d = spark.createDataFrame([*docs, (903, line)], "doc_id bigint, text string")
    i = spark.createDataFrame(items + more, "item_id bigint, text string")
    got = leakage.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(a, b + n) for a, b in truth for n in (0, 100, 200)}
    assert all(r.sentences == 1 for r in got)


def test_what_a_passage_is():
    """Questions go by their form, not by their place; short sentences and items without a question keep all they have."""
    p = ["The kilbo engine was first built in Dremo in 1911 by two clerks", "Its handle is made of old copper", "No one in Vantu could ever read the third ledger of it"]
    of = lambda *items: {(i, " ".join(t)) for _, i, t in leakage.passage_sentences(list(items))}
    whole = {" ".join(leakage.tokens_of(s)) for s in p}
    body = ". ".join(p) + "."
    for text in (body, body + " What was it made of?", body + " Explain why no one in Vantu could read it.", body + ' "Who was it?"'):
        assert of((1, text)) == {(1, s) for s in whole}
    assert of((1, body + " Why?"), (2, body + " Who built it first and where was that?")) == {(i, s) for i in (1, 2) for s in whole}
    others = [(i, f"The {w} valve of {w} opens at noon each day. Nobody in {w} has seen the {w} ledger since. Which of these follows from the passage above?") for i, w in enumerate(("bora", "kile", "sume"), 5)]
    got = of((1, body + " Which of these follows from the passage above?"), *others)
    assert {s for i, s in got if i == 1} == whole and not any(s.startswith("which") for _, s in got)


def test_too_many_items_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS", 1)
    i = spark.createDataFrame([(1, "a"), (2, "b")], "item_id bigint, text string")
    with pytest.raises(ValueError):
        leakage.find_leaks(i, "item_id", "text", i, "item_id", "text")


def test_postings_equal_brute_force(spark):
    texts = [(1, "a b a b"), (2, "B. c A-b"), (3, None), (4, "")]
    df = spark.createDataFrame(texts, "id bigint, t string")
    got = {tuple(r) for r in leakage.build_postings(df, "id", "t", ["a b", "b c"]).collect()}
    assert got == {(0, 1, 0), (0, 1, 2), (1, 2, 0), (0, 2, 2)}


# --- 8 subjects -----------------------------------------------------------------------------------------------------

AREAS = {"law": "court judge appeal statute verdict plaintiff", "sport": "goal match referee striker league stadium", "code": "compiler kernel thread pointer debugger stack"}
FILLER = "we also note that this part was written in a hurry and may be skipped by most who read it".split()


def subject_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        chosen = rng.sample(sorted(AREAS), rng.choice([0, 1, 1, 2]))
        passing = [a for a in AREAS if a not in chosen]
        plan = [a for a in chosen for _ in range(rng.randint(2, 4))] + [rng.choice(passing)] * rng.randint(0, 1) + [None] * 3
        rng.shuffle(plan)
        sentences = [" ".join(rng.sample(FILLER, 6) + (rng.sample(AREAS[a].split(), 2) if a else [])) for a in plan]
        out.append((i, ". ".join(sentences) + ".", chosen))
    return out


def test_subjects_on_held_out_texts(spark):
    rows = subject_texts(900, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (9003, "Court judge appeal.")], "id bigint, text string")
    labels = spark.createDataFrame([(i, a) for i, _, areas in rows[:600] for a in areas] + [(77777, "law"), (1, "nonsense")], "id bigint, area string")
    model = subjects.fit_areas(docs, "id", "text", labels, "area", sorted(AREAS))
    got = {(r.id, r.area) for r in subjects.areas_of(docs, "id", "text", model).collect()}
    truth = {(i, a) for i, _, areas in rows[600:] for a in areas}
    held = {p for p in got if p[0] >= 600}
    assert len(held & truth) >= 0.95 * len(truth) and len(held - truth) <= 0.05 * len(truth)
    assert not {p for p in got if p[0] > 9000}
    empty = subjects.fit_areas(docs, "id", "text", labels.limit(0), "area", sorted(AREAS))
    assert subjects.areas_of(docs, "id", "text", empty).count() == 0
    assert subjects.areas_of(docs.limit(0), "id", "text", model).count() == 0


def test_steps_send_one_sum_whatever_the_cores(spark, monkeypatch):
    """Blocks follow the labels; their weighted sum is the gradient of all documents, one row of bounded size."""
    rows = subject_texts(40, 8)
    labels = np.array([[a in areas for a in sorted(AREAS)] for *_, areas in rows], dtype=np.float32)
    m = subjects.Areas(sorted(AREAS))
    texts = [t for _, t, _ in rows]
    whole = subjects.Block(texts, labels).gradient(m.embeddings, m.outputs, m.bias, True)
    parts = [(slice(0, 13), 13), (slice(13, 40), 27)]
    slopes = []
    for at, n in parts:
        where, g, o, b, loss = subjects.Block(texts[at], labels[at]).gradient(m.embeddings, m.outputs, m.bias, True)
        slopes.append(subjects.slope_row(n, loss, where, g, o, b))
    (total,) = subjects.add_slopes(iter(slopes))
    assert len(total) == 1 and total["n"][0] == 40 and np.array_equal(np.frombuffer(total["w"][0], np.int32), whole[0])
    assert np.allclose(np.frombuffer(total["g"][0], np.float32).reshape(-1, subjects.WIDTH), whole[1], atol=1e-6)
    assert np.allclose(np.frombuffer(total["b"][0], np.float32), whole[3], atol=1e-6)
    monkeypatch.setattr(subjects, "PER_BLOCK", 100)
    rows = subject_texts(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "id bigint, text string")
    marks = spark.createDataFrame([(i, a) for i, _, areas in rows for a in areas], "id bigint, area string")
    a, b = (subjects.fit_areas(docs.repartition(n), "id", "text", marks, "area", sorted(AREAS), steps=3) for n in (1, 9))
    assert np.allclose(a.embeddings, b.embeddings, atol=1e-4)


def test_gradient_equals_differences():
    rows = subject_texts(12, 8)
    labels = np.array([[a in areas for a in sorted(AREAS)] for *_, areas in rows], dtype=np.float32)
    block = subjects.Block([t for _, t, _ in rows], labels)
    block = subjects.Block.load(block.dump())
    m = subjects.Areas(sorted(AREAS))
    _, _, g_out, g_bias, _ = block.gradient(m.embeddings, m.outputs, m.bias, True)

    def loss(out, bias):
        return block.gradient(m.embeddings, out, bias, True)[4] / len(rows)

    step = 1e-2
    for k in range(3):
        up, down = m.bias.copy(), m.bias.copy()
        up[k] += step
        down[k] -= step
        assert abs((loss(m.outputs, up) - loss(m.outputs, down)) / (2 * step) - g_bias[k]) < 2e-3
    up, down = m.outputs.copy(), m.outputs.copy()
    up[2, 1] += step
    down[2, 1] -= step
    assert abs((loss(up, m.bias) - loss(down, m.bias)) / (2 * step) - g_out[2, 1]) < 2e-3
