"""Filling containers of fixed capacity with whole texts.

Bulk-synchronous best-fit. Texts are counted in tokens of a public tokenizer and sorted by size; equal sizes form one
class, and so do containers with an equal gap, so both sides are run-length encoded: a run is a size (or gap) with a
range of ranks. In each round the runs of texts, largest first, are swept against the runs of gaps: a text goes to
the smallest gap that holds it (its successor); where several runs want one gap, ranks decide and the rest sweep on;
then all gaps are updated and the next round begins. Rounds go down through the sizes by halves; texts of the current
half that no gap can hold open as many new containers as their volume needs. One task plans each capacity; it holds
runs, whose number is bounded by capacity and rounds, not by the number of texts. Each text then finds its run by size
and rank.

A text longer than a container is split into full pieces, each a container of its own, and a rest that is packed like
a text. Ranks within a size are taken in buckets, so that a size which a third of all texts share is not one task.

Defined results: NULL and blank texts have 0 tokens and go into container 0, which is kept for them; repeated texts
are packed each for itself; ties in size are ranked by the hash of the id, then the id; a NULL size counts as 0; no texts
or no capacities give no rows; capacities below 1 are an error; extra columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import cut

#: Buckets of a size: a size that a third of all texts share is so many tasks' work at least.
BUCKETS = 1024
_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(df: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """``id_col, tokens`` with the tokenizer's rank file at the path ``tokenizer``, which every executor can read."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(tokenizer).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t is not None and t.strip() else 0)

    return df.select(F.col(id_col), count(text_col).alias("tokens"))


class Gaps:
    """Containers by gap, as runs ``(first container, count)``."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, deque] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap <= 0:
            return
        if gap not in self.runs:
            self.sizes.insert(bisect_left(self.sizes, gap), gap)
            self.runs[gap] = deque()
        runs = self.runs[gap]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + count)
        else:
            runs.append((first, count))

    def take(self, at_least: int, count: int) -> tuple[int, int, int] | None:
        """Up to ``count`` containers of the smallest gap that holds ``at_least``: ``(gap, first, count)``."""
        i = bisect_left(self.sizes, at_least)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, n = self.runs[gap].popleft()
        if n > count:
            self.runs[gap].appendleft((first + count, n - count))
            n = count
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.pop(i)
        return gap, first, n


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs ``(size, first rank, count, first container)`` for ``counts`` texts of each of the ``sizes`` up to ``capacity``."""
    left = {int(s): int(n) for s, n in zip(sizes, counts, strict=True) if 0 < s <= capacity and n > 0}
    rank: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int]] = []
    gaps, opened = Gaps(), 1
    order = sorted(left, reverse=True)
    at = 0
    while at < len(order):
        floor = order[at] / 2
        end = at
        while end < len(order) and order[end] > floor:
            end += 1
        active = order[at:end]
        while active:
            fresh: list[tuple[int, int, int]] = []  # gaps are updated after the sweep
            unfit = []
            for s in active:
                while left[s]:
                    got = gaps.take(s, left[s])
                    if got is None:
                        unfit.append(s)
                        break
                    gap, first, n = got
                    out.append((s, rank[s], n, first))
                    rank[s] += n
                    left[s] -= n
                    fresh.append((gap - s, first, n))
            # only texts that no gap of the next round can hold open new containers
            widest = max((g for g, _, _ in fresh), default=0)
            stuck = [s for s in unfit if s > widest]
            if stuck:
                volume = sum(s * left[s] for s in stuck)
                need = max(-(-volume // capacity), sum(left[s] for s in stuck if s > capacity / 2))
                for s in stuck:
                    n = min(left[s], need)
                    if n:
                        out.append((s, rank[s], n, opened))
                        rank[s] += n
                        left[s] -= n
                        need -= n
                        fresh.append((capacity - s, opened, n))
                        opened += n
            for gap, first, n in sorted(fresh, key=lambda x: (x[0], x[1])):
                gaps.add(gap, first, n)
            active = [s for s in unfit if left[s]]
        at = end
    return out


def pack(items: DataFrame, id_col: str, size_col: str, containers: DataFrame, pack_col: str, capacity_col: str) -> DataFrame:
    """``pack_col, id_col, piece, tokens, container`` for every capacity: one row per piece of each item.

    ``containers`` is the list of capacities, a few rows. Items of one size fall into ``BUCKETS`` buckets by the hash of
    their id; a bucket's first rank follows from the counts before it, so the ranks of a size are the same however
    many rows there are, and no task holds more than a bucket. The plan stays a table: each bucket is joined with the runs
    that its ranks meet, and each item with its bucket.
    """
    packs = [(r[0], int(r[1])) for r in containers.select(pack_col, capacity_col).orderBy(pack_col).collect()]
    if any(c < 1 for _, c in packs):
        raise ValueError("a capacity is below 1")
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("tokens")
    items = cut(items.select(F.col(id_col).alias("_id"), size, F.pmod(F.xxhash64(id_col), F.lit(BUCKETS)).cast("int").alias("bucket")), "sizes")
    cells = cut(items.groupBy("tokens", "bucket").agg(F.count("*").alias("n")), "cells")
    kind = dict(containers.dtypes)[pack_col]
    shape = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(p).cast(kind).alias("pack"), F.lit(c).cast("bigint").alias("capacity")) for i, (p, c) in enumerate(packs)])
    if not packs:
        shape = shape.cast(f"array<struct<no:int,pack:{kind},capacity:bigint>>")
    # as many rows as there are different sizes
    histogram = cells.where("tokens > 0").groupBy("tokens").agg(F.sum("n").alias("n")).withColumn("p", F.explode(shape)).select("p.no", "p.capacity", "tokens", "n")

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tokens")
        capacity = int(pdf["capacity"].iloc[0])
        tokens, n = pdf["tokens"].to_numpy(), pdf["n"].to_numpy()
        rest = np.where(tokens > capacity, tokens % capacity, tokens)
        sizes, inverse = np.unique(rest, return_inverse=True)
        totals = np.bincount(inverse, weights=n).astype(np.int64)
        runs = plan(sizes, totals, capacity)
        mixed = max((first + k - 1 for _, _, k, first in runs), default=0)
        # first rank of each original size among the texts with an equal rest
        order = np.lexsort((tokens, inverse))
        before = np.cumsum(n[order]) - n[order]
        group_start = np.concatenate([[0], np.cumsum(totals)[:-1]])
        first_rank = np.zeros(len(n), dtype=np.int64)
        first_rank[order] = before - group_start[inverse[order]]
        full = np.where(tokens > capacity, tokens // capacity, 0)
        first_full = mixed + 1 + np.cumsum(full * n) - full * n
        a = pd.DataFrame({"what": 0, "size": tokens, "low": first_rank, "n": n, "first": first_full})
        b = pd.DataFrame(runs, columns=["size", "low", "n", "first"]).assign(what=1)
        out = pd.concat([a, b[["what", "size", "low", "n", "first"]]], ignore_index=True)
        out.insert(0, "no", pdf["no"].iloc[0])
        return out

    planned = cut(histogram.groupBy("no").applyInPandas(sweep, "no int, what int, size long, low long, n long, first long"), "plan")
    base = planned.where("what = 0").select("no", F.col("size").alias("tokens"), F.col("low").alias("shift"), F.col("first").alias("full_from"))
    # the runs of one size: bounded by the different gaps, not by the number of texts
    runs = planned.where("what = 1").groupBy("no", F.col("size").alias("rest")).agg(F.array_sort(F.collect_list(F.struct("low", "n", "first"))).alias("runs"))

    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("p", F.explode(shape)).select("tokens", "bucket", "n", "start", "p.*")
    longer = F.col("tokens") > F.col("capacity")
    each = each.withColumn("full", F.when(longer, F.expr("tokens div capacity")).otherwise(F.lit(0)))
    each = each.withColumn("rest", F.when(longer, F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens")))
    each = each.join(base, ["no", "tokens"], "left").join(runs, ["no", "rest"], "left")
    low = F.col("start") + F.col("shift")
    met = F.filter("runs", lambda r: (r["low"] < low + F.col("n")) & (r["low"] + r["n"] > low)).alias("runs")
    by_cell = each.groupBy("tokens", "bucket").agg(
        F.collect_list(F.struct("start", "pack", "capacity", "full", "rest", "shift", "full_from", met)).alias("plans")
    )
    own = Window.partitionBy("tokens", "bucket").orderBy("_id")
    ranked = items.withColumn("at", F.row_number().over(own).cast("bigint") - 1).join(by_cell, ["tokens", "bucket"])
    rows = ranked.select("_id", "at", F.explode("plans").alias("p")).select("_id", (F.col("at") + F.col("p.start")).alias("rank"), "p.*")
    place = F.col("rank") + F.col("shift")
    run = F.get(F.filter("runs", lambda r: (r["low"] <= place) & (place < r["low"] + r["n"])), 0)
    rows = rows.withColumn("run", run)
    rest_in = F.when(F.col("rest") > 0, F.col("run.first") + place - F.col("run.low")).otherwise(F.lit(0))
    last = F.array(F.struct(F.col("full").alias("piece"), F.col("rest").alias("tokens"), rest_in.alias("container")))
    pieces = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1),
        lambda i: F.struct(i.alias("piece"), F.col("capacity").alias("tokens"), (F.col("full_from") + F.col("rank") * F.col("full") + i).alias("container")),
    )
    every = F.when(F.col("full") == 0, last).when(F.col("rest") == 0, pieces).otherwise(F.concat(pieces, last))
    return rows.select(F.col("pack").alias(pack_col), F.col("_id").alias(id_col), F.explode(every).alias("x")).select(pack_col, id_col, "x.piece", "x.tokens", "x.container")


def fill_report(packed: DataFrame, containers: DataFrame, pack_col: str, capacity_col: str) -> DataFrame:
    """For each capacity the containers used, the tokens in them and the share of room unused."""
    used = packed.where("container > 0").groupBy(pack_col).agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * F.col(capacity_col)
    return used.join(containers, pack_col).select(pack_col, capacity_col, "containers", "tokens", (1 - F.col("tokens") / room).alias("unused"))
