"""Subject areas of documents.

The model averages word and subword embeddings over each sentence and has one independent logistic output per area. A
document is about an area if at least ``SENTENCES`` of its sentences are: training therefore compares the label with
the score of the ``SENTENCES``-th best sentence of the document. Gradients are computed on the partitions of the
labelled documents, summed on an executor, and applied on the driver, step by step; every document is then scored.

The model is linear in its words, so a word's share of all outputs is computed once per task and reused.

Fitted on at most ``LABELLED`` labelled documents (those with the smallest hash of their id), in blocks of about
``PER_BLOCK``: the blocks follow the labels, not the cores. A step sends the driver one sum of at most ``BUCKETS`` times
``WIDTH`` numbers. Steps, width and buckets are parameters; none depends on the data.

Defined results: NULL and blank texts are on no area; a document needs two sentences, so shorter ones are on no area;
repeated documents get equal areas; labels of unknown documents or areas are ignored; without labels no document gets
an area; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut, discard

SENTENCES = 2
BUCKETS, WIDTH, STEPS, WARM = 1 << 15, 16, 40, 12
LABELLED, PER_BLOCK = 20_000, 2_500
RATE_WARM, RATE, PULL = 0.2, 0.3, 0.002
#: Added to every output when documents are scored; above 0 a sentence counts a little sooner than in training.
LEAN = 1.5
SUBWORD = 4
_TOKENS = re.compile(r"[^\W\d_]+|[.!?。](?=\s)|\n")


class Words:
    """Numbers for words, and for each word the buckets of itself and its subwords."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.buckets: list[int] = []
        self.ends: list[int] = []

    def add(self, word: str) -> int:
        n = self.number[word] = len(self.ends)
        self.buckets.append(xxhash.xxh32_intdigest(word) & (BUCKETS - 1))
        if len(word) > SUBWORD:
            marked = f"<{word}>"
            self.buckets += [xxhash.xxh32_intdigest(marked[i : i + SUBWORD], 1) & (BUCKETS - 1) for i in range(len(marked) - SUBWORD + 1)]
        self.ends.append(len(self.buckets))
        return n


def read_texts(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word numbers, first word of each sentence, first sentence of each text)`` of all texts, one after the other."""
    number = words.number
    flat: list[int] = []
    starts, firsts = [], []
    for text in texts:
        firsts.append(len(starts))
        begin = len(flat)
        for t in _TOKENS.findall(text.lower()):
            n = number.get(t)
            if n is None:
                if t in ".!?。\n":
                    if len(flat) > begin:
                        starts.append(begin)
                        begin = len(flat)
                    continue
                n = words.add(t)
            flat.append(n)
        if len(flat) > begin:
            starts.append(begin)
    return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(firsts, dtype=np.int64)


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0) if len(starts) else np.zeros((0, rows.shape[1]), rows.dtype)


class Block:
    """Labelled documents of one block, ready for gradients."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        words = Words()
        self.flat, self.starts, firsts = read_texts(texts, words)
        self.labels = labels.astype(np.float32)
        self.buckets = np.array(words.buckets, dtype=np.int32)
        self.word_starts = np.concatenate([[0], np.array(words.ends, dtype=np.int64)[:-1]]) if words.ends else np.zeros(0, np.int64)
        self.doc_of = np.repeat(np.arange(len(texts)), np.diff(np.append(firsts, len(self.starts))))
        self.order = np.argsort(self.flat, kind="stable")
        # a block is read again in each step
        for name in ("flat", "starts", "word_starts", "doc_of", "order"):
            setattr(self, name, getattr(self, name).astype(np.int32))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Block:
        out = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            out.__dict__ = {k: parts[k] for k in parts.files}
        return out

    def gradient(self, embeddings: np.ndarray, outputs: np.ndarray, bias: np.ndarray, warm: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """``(touched buckets, their gradient, outputs' gradient, bias' gradient, loss)``."""
        n_docs, n_areas = self.labels.shape
        per_word = np.diff(np.append(self.word_starts, len(self.buckets)))[:, None].astype(np.float32)
        vectors = _sums(embeddings[self.buckets], self.word_starts) / per_word
        lengths = np.diff(np.append(self.starts, len(self.flat)))[:, None].astype(np.float32)
        sentences = _sums(vectors[self.flat], self.starts) / lengths
        z = sentences @ outputs + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        doc = self.doc_of
        wanted = self.labels[doc]
        delta = np.zeros_like(z)
        if warm:
            counts = np.bincount(doc, minlength=n_docs)[doc][:, None]
            delta = (p - wanted) / counts
            loss = float(-(np.log(np.where(wanted > 0, p, 1 - p) + 1e-9) / counts).sum())
        else:
            loss = 0.0
            first = np.searchsorted(doc, np.arange(n_docs + 1))
            for k in range(n_areas):
                ranked = np.lexsort((-z[:, k], doc))  # within each document, best sentence first
                place = np.arange(len(doc)) - first[doc[ranked]]
                on = self.labels[doc[ranked], k] > 0
                up = ranked[on & (place < SENTENCES)]
                down = ranked[~on & (place >= SENTENCES - 1) & (place < SENTENCES + 2)]
                rest = ranked[~on & (place >= SENTENCES + 2)]
                delta[up, k] = p[up, k] - 1
                delta[down, k] = p[down, k]
                delta[rest, k] = p[rest, k] * 0.3
                loss += float(-np.log(p[up, k] + 1e-9).sum() - np.log(1 - p[down, k] + 1e-9).sum())
        delta = delta.astype(np.float32) / n_docs
        g_out = sentences.T @ delta
        g_bias = delta.sum(axis=0)
        g_sentence = (delta @ outputs.T) / lengths
        sentence_of = np.repeat(np.arange(len(self.starts)), lengths[:, 0].astype(np.int64))
        by_word = g_sentence[sentence_of[self.order]]
        present = np.flatnonzero(np.diff(np.append(-1, self.flat[self.order])))
        g_word = _sums(by_word, present) / per_word
        word_of = np.repeat(np.arange(len(self.word_starts)), per_word[:, 0].astype(np.int64))
        order = np.argsort(self.buckets, kind="stable")
        edges = np.flatnonzero(np.diff(np.append(-1, self.buckets[order])))
        return self.buckets[order][edges], _sums(g_word[word_of[order]], edges), g_out, g_bias, loss


class Areas:
    """Embeddings, outputs and biases; updated with Adam-like steps."""

    def __init__(self, areas: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.areas = areas
        self.embeddings = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
        self.outputs = (rng.standard_normal((WIDTH, len(areas)))).astype(np.float32)
        self.bias = np.full(len(areas), -2.0, dtype=np.float32)
        self._m = [np.zeros_like(x) for x in (self.embeddings, self.outputs, self.bias)]
        self._v = [np.zeros_like(x) for x in (self.embeddings, self.outputs, self.bias)]
        self._t = 0

    def step(self, gradients: tuple[np.ndarray, np.ndarray, np.ndarray], rate: float) -> None:
        self._t += 1
        for x, g, m, v in zip((self.embeddings, self.outputs, self.bias), gradients, self._m, self._v, strict=True):
            m *= 0.8
            m += 0.2 * g
            v *= 0.95
            v += 0.05 * g * g
            x -= rate * (m / (1 - 0.8**self._t)) / (np.sqrt(v / (1 - 0.95**self._t)) + 1e-7)

    def scorer(self) -> tuple[np.ndarray, np.ndarray]:
        """Share of each bucket in the outputs, and the biases: all that scoring needs."""
        return (self.embeddings @ self.outputs).astype(np.float32), self.bias + np.float32(LEAN)


SLOPE = "n int, loss double, w binary, g binary, o binary, b binary"


def slope_row(n: int, loss: float, where: np.ndarray, rows: np.ndarray, out: np.ndarray, bias: np.ndarray) -> pd.DataFrame:
    numbers = {"w": where.astype(np.int32), "g": rows.astype(np.float32), "o": out.astype(np.float32), "b": bias.astype(np.float32)}
    return pd.DataFrame({"n": [n], "loss": [loss]} | {k: [v.tobytes()] for k, v in numbers.items()})


def add_slopes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mean of the blocks' gradients, weighted by their documents, as one row; only buckets that a block touched."""
    n, loss, touched, g, o, b = 0, 0.0, np.zeros(BUCKETS, dtype=bool), np.zeros((BUCKETS, WIDTH), dtype=np.float32), 0.0, 0.0
    for batch in batches:
        for r in batch.itertuples():
            where = np.frombuffer(r.w, np.int32)
            touched[where] = True
            g[where] += np.float32(r.n) * np.frombuffer(r.g, np.float32).reshape(-1, WIDTH)
            o, b = o + r.n * np.frombuffer(r.o, np.float32), b + r.n * np.frombuffer(r.b, np.float32)
            n, loss = n + r.n, loss + r.loss
    if n:
        where = np.flatnonzero(touched)
        yield slope_row(n, loss, where, g[where] / np.float32(n), o / n, b / n)


def fit_areas(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, area: str, areas: list[str], labelled: int = LABELLED, steps: int = STEPS) -> Areas:
    """Train on the labelled documents; ``labels`` has ``doc_id, area`` and is complete for the documents it lists."""
    model = Areas(areas)
    spark = docs.sparkSession
    wanted = labels.where(F.col(area).isin(areas)).groupBy(doc_id).agg(F.collect_set(area).alias("_areas"))
    chosen = cut(wanted.orderBy(F.xxhash64(doc_id), doc_id).limit(labelled), "labelled")
    parts = max(1, -(-chosen.count() // PER_BLOCK))
    rows = docs.where(F.col(text).isNotNull()).select(doc_id, F.col(text).alias("_text")).join(F.broadcast(chosen), doc_id)  # at most ``labelled`` rows
    place = {a: i for i, a in enumerate(areas)}

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, marks = [], []
        for b in batches:
            texts += b["_text"].tolist()
            marks += b["_areas"].tolist()
        if texts:
            y = np.zeros((len(texts), len(areas)), dtype=np.float32)
            for i, m in enumerate(marks):
                for a in m:
                    y[i, place[a]] = 1
            yield pd.DataFrame({"n": [len(texts)], "block": [Block(texts, y).dump()]})

    blocks = cut(rows.repartition(parts, doc_id).mapInPandas(build, "n int, block binary"), "blocks")
    sizes = blocks.agg(F.sum("n")).first()[0] or 0
    if not sizes:
        model.bias[:] = -30
        return model
    for step in range(steps):
        sent = spark.sparkContext.broadcast((model.embeddings, model.outputs, model.bias))
        warm = step < WARM

        def slope(batches: Iterator[pd.DataFrame], sent=sent, warm=warm) -> Iterator[pd.DataFrame]:
            for b in batches:
                for n, data in zip(b["n"], b["block"], strict=True):
                    where, rows, out, bias, loss = Block.load(data).gradient(*sent.value, warm)
                    yield slope_row(n, loss, where, rows, out, bias)

        slopes = blocks.mapInPandas(slope, SLOPE)
        # one row of at most BUCKETS x WIDTH numbers, whatever the cores and blocks
        got = slopes.collect() if parts == 1 else slopes.repartition(1).mapInPandas(add_slopes, SLOPE).collect()
        sent.destroy()
        g = [np.zeros_like(model.embeddings), np.zeros_like(model.outputs), np.zeros_like(model.bias)]
        for r in got:
            share = np.float32(r.n / sizes)
            g[0][np.frombuffer(r.w, np.int32)] += share * np.frombuffer(r.g, np.float32).reshape(-1, WIDTH)
            g[1] += share * np.frombuffer(r.o, np.float32).reshape(WIDTH, -1)
            g[2] += share * np.frombuffer(r.b, np.float32)
        g[0] += np.float32(PULL / BUCKETS) * model.embeddings
        model.step(tuple(g), (RATE_WARM if warm else RATE) * (1 - 0.8 * step / steps))
    discard(blocks, chosen)
    return model


def score_texts(texts: list[str], shares: np.ndarray, bias: np.ndarray, words: Words, known: list[np.ndarray]) -> np.ndarray:
    """Number of sentences on each area, for each text. ``words`` and ``known`` are kept from batch to batch."""
    flat, starts, firsts = read_texts(texts, words)
    have = sum(len(k) for k in known)
    if len(words.ends) > have:
        ends = np.array([words.ends[have - 1] if have else 0, *words.ends[have:]])
        rows = shares[np.array(words.buckets[ends[0] :], dtype=np.int64)]
        known.append(_sums(rows, ends[:-1] - ends[0]) / np.diff(ends)[:, None].astype(np.float32))
        known[:] = [np.concatenate(known)] if len(known) > 8 else known
    counts = np.zeros((len(texts), len(bias)), dtype=np.int32)
    if not len(starts):
        return counts
    vectors = np.concatenate(known) if len(known) > 1 else known[0]
    lengths = np.diff(np.append(starts, len(flat)))[:, None].astype(np.float32)
    on = (_sums(vectors[flat], starts) / lengths + bias) > 0
    doc_of = np.repeat(np.arange(len(texts)), np.diff(np.append(firsts, len(starts))))
    for k in range(len(bias)):
        counts[:, k] = np.bincount(doc_of[on[:, k]], minlength=len(texts))
    return counts


def areas_of(docs: DataFrame, doc_id: str, text: str, model: Areas, at_least: int = SENTENCES) -> DataFrame:
    """``doc_id, area, sentences`` for each area that at least ``at_least`` sentences of a document treat."""
    shares, bias = model.scorer()
    sent = docs.sparkSession.sparkContext.broadcast((shares, bias, model.areas))
    kind = dict(docs.dtypes)[doc_id]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shares, bias, areas = sent.value
        words, known = Words(), []
        for b in batches:
            if len(words.ends) > 400_000:  # bounds a task's memory; the words are read again when they come again
                words, known = Words(), []
            counts = score_texts(b["_text"].tolist(), shares, bias, words, known)
            i, k = np.nonzero(counts >= at_least)
            yield pd.DataFrame({doc_id: b[doc_id].to_numpy()[i], "area": np.array(areas, dtype=object)[k], "sentences": counts[i, k]})

    texts = docs.where(F.col(text).isNotNull()).select(doc_id, F.col(text).alias("_text"))
    return texts.mapInPandas(score, f"`{doc_id}` {kind}, area string, sentences int")
