"""Evaluation passages inside training text.

A positional inverted index over the training documents holds postings ``(term, doc, position)`` of the passages'
own terms; a term is a pair of neighbouring tokens, since a pair is far rarer than its tokens, and one changed word
spoils two pairs only. For each sentence of a passage the rarest terms (by their frequency in the index) are looked
up, their positions shifted by the term's place in the sentence, and the lists intersected: places where at least two
of the rarest terms meet at one shift are candidates. A candidate's neighbourhood is then aligned with the whole sentence;
exact phrases and near ones (words changed, left out or put in) come out with their coverage.

What counts as a passage: all sentences of an item but the instruction lines (sentences that several different texts
share at their opening or end while their other sentences differ) and the question, which is told by its form: what
stands last and ends in a question mark or opens with the verb of a task. An item without a question keeps all its
sentences. A passage that several items share is a passage of each of them.

Defined results: NULL and blank documents carry nothing; sentences of fewer than ``SHORTEST`` words are no evidence;
copies of a document count separately; an item row delivered twice counts once, and the same text under two ids is two
items; long documents are read whole; an empty table on either side gives no rows; extra columns are ignored; more than
``ITEMS`` items are an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut, discard

RAREST, MEET, SLACK = 8, 2, 3
COVERAGE, SHORTEST = 0.82, 5
#: Items up to which the stated query set may be held by the driver and every task.
ITEMS = 1_000_000
#: Share of a sentence's weight that must be covered too; a word weighs the less the more of the sentences have it, so
#: that sentences which are only built alike do not pass.
WEIGHT = 0.5
#: A term in more than this share of the sentences leads to no sentence in particular.
LEADS = 0.02
#: Rows up to which a side may be sent to every task; beyond it both sides are shuffled.
SMALL = 200_000
BREAK = re.compile(r"(?<!\bDr)(?<!\bMr)(?<!\bMrs)(?<!\bProf)(?<!\bSt)(?<!\bNo)(?<!\bvs)(?<!\be\.g)(?<!\bi\.e)(?<=[.!?])[\"'”’)]?\s+")
_TOKENS = re.compile(r"[^\W_]+")
# Words that open a task.
TASKS = frozenset("explain describe discuss justify compare summarize summarise choose select determine identify compute prove list name".split())


def asks(sentence: str) -> bool:
    """True for a question, which ends in its mark, or a task, which opens with its verb."""
    first = _TOKENS.search(sentence.lower())
    return sentence.rstrip().rstrip("\"'”’)]").endswith("?") or bool(first) and first.group() in TASKS


def tokens_of(text: str) -> list[str]:
    return _TOKENS.findall(text.lower())


def _run(text: tuple[str, ...], common: set[str], side: int) -> list[str]:
    """The common sentences that ``text`` opens with (side 0) or ends in (side 1)."""
    return list(takewhile(common.__contains__, reversed(text) if side else text))


def instruction_lines(texts: list[tuple[str, ...]]) -> set[str]:
    """Sentences that stand at an end of several texts whose passages differ. ``texts`` are distinct lists of sentences.

    Two texts differ if each has two sentences at least, a passage and a question, between what they share at their
    ends, and nothing there is shared. Two such texts will do where the line is all they share at that end, three where
    it is not, as a part of a passage may be shared too.
    """
    at: dict[str, list[int]] = {}
    for n, text in enumerate(texts):
        for k in set(text):
            at.setdefault(k, []).append(n)
    out = set()
    for k, where in at.items():
        for side in (0, 1):
            unlike: list[int] = []
            alone = False
            for n in where if len(where) > 1 else ():
                ok = len(texts[n]) > 2
                for o in unlike:
                    a, b = texts[n], texts[o]
                    common = set(a) & set(b)
                    inner = [t[len(_run(t, common, 0)) : len(t) - len(_run(t, common, 1))] for t in (a, b)]
                    shared = any(s in common and s.count(" ") + 1 >= SHORTEST for s in inner[0])
                    runs = [_run(t, common, side) for t in (a, b)]
                    ok = ok and not shared and min(map(len, inner)) >= 2 and all(k in r for r in runs)
                    alone = alone or ok and set(runs[0]) == set(runs[1]) == {k}
                if ok:
                    unlike.append(n)
                if alone or len(unlike) == 3:
                    out.add(k)
                    break
    return out


def passage_sentences(items: list[tuple[int, str]]) -> list[tuple[int, int, list[str]]]:
    """``(sentence number, item, tokens)`` of the items' passages. An item delivered twice counts once."""
    split: dict[tuple[int, tuple[str, ...]], list[bool]] = {}
    for item, text in items:
        raw = [s for s in BREAK.split(text or "") if s and s.strip()]
        split[item, tuple(" ".join(tokens_of(s)) for s in raw)] = [asks(s) for s in raw]
    lines = instruction_lines(list(dict.fromkeys(sentences for _, sentences in split)))
    out = []
    for (item, sentences), questions in split.items():
        low, high = 0, len(sentences)
        while low < high and sentences[low] in lines:
            low += 1
        while low < high and (sentences[high - 1] in lines or questions[high - 1]):
            high -= 1
        for tokens in [s.split() for s in sentences[low:high]]:
            if len(tokens) >= SHORTEST:
                out.append((len(out), item, tokens))
    return out


def distinct_sentences(sentences: list[tuple[int, int, list[str]]]) -> list[tuple[int, list[int], list[str]]]:
    """``(number, items, tokens)``: each sentence once, with all items that have it."""
    items: dict[tuple[str, ...], list[int]] = {}
    for _, item, tokens in sentences:
        items.setdefault(tuple(tokens), []).append(item)
    return [(n, of, list(tokens)) for n, (tokens, of) in enumerate(items.items())]


def pairs_of(tokens: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]


def leading_terms(sentences: list[tuple[int, list[int], list[str]]]) -> dict[str, list[tuple[int, int]]]:
    """Terms to index, with their ``(sentence, place)``: those in few sentences, at least RAREST + 2 of each sentence."""
    spread = Counter(t for _, _, tokens in sentences for t in set(pairs_of(tokens)))
    limit = max(3, LEADS * len(sentences))
    out: dict[str, list[tuple[int, int]]] = {}
    for number, _, tokens in sentences:
        pairs = pairs_of(tokens)
        ranked = sorted(set(pairs), key=lambda t: (spread[t], t))
        keep = {t for i, t in enumerate(ranked) if spread[t] <= limit or i < RAREST + 2}
        for place, t in enumerate(pairs):
            if t in keep:
                out.setdefault(t, []).append((number, place))
    return out


def build_postings(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """The index: ``term, doc, position`` for the given terms, over all documents, as a written table.

    ``term`` is the term's place in the list. Tokens become numbers by one look-up each; pairs are then numbers too.
    """
    words = {w: i for i, w in enumerate(sorted({w for t in terms for w in t.split(" ")}), 1)}
    width = len(words) + 1
    codes = np.array([words[a] * width + words[b] for a, b in (t.split(" ") for t in terms)], dtype=np.int64)
    order = np.argsort(codes)
    sent = docs.sparkSession.sparkContext.broadcast((words, codes[order], order.astype(np.int32)))
    kind = dict(docs.dtypes)[id_col]

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, known, term_of = sent.value
        get = number.get
        for b in batches:
            flat, lengths = [], []
            for text in b["_text"]:
                found = _TOKENS.findall(text.lower())
                flat += [get(w, 0) for w in found]
                flat.append(0)  # no pair goes from one text into the next
                lengths.append(len(found) + 1)
            if not flat:
                continue
            ids = np.array(flat, dtype=np.int64)
            code = ids[:-1] * width + ids[1:]
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            k = np.minimum(np.searchsorted(known, code[at]), len(known) - 1)
            hit = known[k] == code[at]
            at, k = at[hit], k[hit]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            doc = np.searchsorted(starts, at, "right") - 1
            yield pd.DataFrame({"term": term_of[k], "doc": b["_doc"].to_numpy()[doc], "position": (at - starts[doc]).astype(np.int32)})

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    return cut(texts.mapInPandas(post, f"term int, doc {kind}, position int"), "postings")


def _candidates(postings: DataFrame, leads: DataFrame) -> DataFrame:
    """``doc, sentence, at``: places where at least MEET of a sentence's RAREST terms meet at one shift, up to SLACK."""
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    ranked = leads.join(frequency, "term")
    per_term = ranked.groupBy("sentence", "term").agg(F.first("n").alias("n"), F.collect_list("place").alias("places"))
    best = per_term.groupBy("sentence").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "places"))), 1, RAREST).alias("best"))
    anchors = best.select("sentence", F.explode("best").alias("b")).select("sentence", F.col("b.term").alias("term"), F.explode("b.places").alias("place"))
    hits = postings.join(_send(anchors, leads), "term").select(
        "doc", "sentence", "term", (F.col("position") - F.col("place")).alias("shift")
    )
    # shifts fall in two overlapping grids of cells, so that two that are near share one cell at least
    cell = 4 * SLACK
    cells = F.explode(F.array(F.floor(F.col("shift") / cell) * 2, F.floor((F.col("shift") + cell // 2) / cell) * 2 + 1)).alias("cell")
    met = hits.select("doc", "sentence", "term", "shift", cells).groupBy("doc", "sentence", "cell").agg(
        F.collect_set("term").alias("terms"), F.min("shift").alias("at")
    )
    return met.where(F.size("terms") >= MEET).groupBy("doc", "sentence", "at").agg(F.max(F.size("terms")).alias("met"))


def _send(df: DataFrame, bound_by: DataFrame) -> DataFrame:
    """``df`` for sending to every task if its bound, counted first, allows it."""
    return F.broadcast(df) if bound_by.count() <= SMALL else df


def coverage(sentence: list[str], window: list[str]) -> float:
    """Share of the sentence's words that the window has in the same order."""
    have = Counter(window)
    if sum(min(n, have[t]) for t, n in Counter(sentence).items()) < COVERAGE * len(sentence):
        return 0.0
    return in_order(sentence, [1.0] * len(sentence), window)


def in_order(sentence: list[str], weights: list[float], window: list[str]) -> float:
    """Share of the sentence's weight in the heaviest common subsequence with the window."""
    row = [0.0] * (len(window) + 1)
    for t, weight in zip(sentence, weights, strict=True):
        last = 0.0
        for j, w in enumerate(window, 1):
            keep = row[j]
            row[j] = last + weight if t == w else max(row[j], row[j - 1])
            last = keep
    return row[-1] / max(sum(weights), 1e-9)


def word_weights(sentences: list[tuple[int, list[int], list[str]]]) -> list[list[float]]:
    spread = Counter(t for _, _, tokens in sentences for t in set(tokens))
    return [[0.05 + math.log(len(sentences) / spread[t]) for t in tokens] for _, _, tokens in sentences]


def find_leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``doc_id, item_id, sentences, coverage``: documents that carry whole sentences of an item's passage.

    ``sentences`` counts the item's sentences found, ``coverage`` is that of the best one. The items are the stated
    query set; they are read on the driver, which their number, counted first, must allow.
    """
    spark = docs.sparkSession
    if items.count() > ITEMS:
        raise ValueError(f"more than {ITEMS} items: split the query set")
    rows = items.select(item_id, item_text).orderBy(item_id).toPandas()
    sentences = distinct_sentences(passage_sentences(list(zip(rows[item_id].tolist(), rows[item_text].tolist(), strict=True))))
    if not sentences:
        return docs.select(F.col(doc_id), F.lit(0).cast("bigint").alias(item_id), F.lit(0).cast("bigint").alias("sentences"), F.lit(0.0).alias("coverage")).limit(0)
    leads_of = leading_terms(sentences)
    lead_rows = [(i, n, p) for i, places in enumerate(leads_of.values()) for n, p in places]
    leads = spark.createDataFrame(pd.DataFrame(lead_rows, columns=["term", "sentence", "place"]), "term int, sentence int, place int")
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    postings = build_postings(texts, "doc", "text", list(leads_of))
    found = cut(_candidates(postings, leads), "candidates")
    discard(postings)
    places = found.groupBy("doc").agg(F.collect_set(F.struct("sentence", "at")).alias("places"))
    if found.count() <= SMALL:
        places = F.broadcast(places)
    weights = word_weights(sentences)
    query = spark.sparkContext.broadcast([(of, tokens, w) for (_, of, tokens), w in zip(sentences, weights, strict=True)])

    @F.pandas_udf("array<struct<item:bigint,coverage:double>>")
    def verify(text: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, ps in zip(text, places, strict=True):
            tokens, best = tokens_of(t), {}
            for p in ps:
                n, at = p["sentence"], p["at"]
                _, sentence, weights = query.value[n]
                margin = 2 + 4 * SLACK + len(sentence) // 4
                window = tokens[max(0, at - margin) : max(0, at + len(sentence) + margin)]
                share = coverage(sentence, window)
                if share >= COVERAGE and in_order(sentence, weights, window) >= WEIGHT:
                    best[n] = max(best.get(n, 0.0), share)
            out.append([{"item": item, "coverage": c} for n, c in best.items() for item in query.value[n][0]])
        return pd.Series(out)

    checked = texts.join(places, "doc").select("doc", F.explode(verify("text", "places")).alias("v"))
    return checked.groupBy(F.col("doc").alias(doc_id), F.col("v.item").alias(item_id)).agg(
        F.count("*").alias("sentences"), F.max("v.coverage").alias("coverage")
    )
