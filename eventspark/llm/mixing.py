"""Mix sources to target weights: water-filled word targets, met by bounded-knapsack budget fitting."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.common import materialize, numbered, words_of


def water_fill(totals: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """Targets by source. Sources go by code point, null last, with ``weights`` repeating; together they get
    ``share`` of all sizes. A target stops at ``most`` times its source's size and its excess is shared again by
    weight among the others, until none is above."""
    names = sorted((x for x in totals if x is not None)) + [None] * (None in totals)
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    budget, open_, out = share * sum(totals.values()), list(names), {}
    while open_:
        per = budget / sum(weight[x] for x in open_)
        over = [x for x in open_ if per * weight[x] > most * totals[x]]
        if not over:
            out |= {x: per * weight[x] for x in open_}
            break
        for x in over:
            out[x] = Fraction(most * totals[x])
            budget -= out[x]
        open_ = [x for x in open_ if x not in out]
    return out


def fit_budget(sizes: list[int], counts: list[int], budget: int, dense: int = 50_000) -> list[int]:
    """How many documents of each size to take, at most ``counts``, so that the words come to ``budget`` or the
    nearest sum below it that the steps reach.

    First the same share of every size (rounded down), then the largest sizes until at most ``dense`` words are
    left, then an exact bounded-knapsack dynamic programme (bit sets, counts split into powers of two) over the
    documents that remain. If that misses the budget, documents are given back, the smallest first and four times as
    many words each time, up to ``dense`` words, and the programme runs again over all that is free; the best sum
    stays. A budget of at most ``dense`` words ends with all documents free, so its sum is the best there is.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return list(counts)
    words = lambda take: sum(s * t for s, t in zip(sizes, take, strict=True))
    share = [c * budget // total if s > 0 else 0 for s, c in zip(sizes, counts, strict=True)]
    best, back = _fit(sizes, counts, budget, dense, list(share)), dense // 64
    while words(best) < budget and back < 4 * dense and any(share):
        free = min(back, dense)
        for i in sorted(range(len(sizes)), key=sizes.__getitem__):
            k = min(share[i], -(-free // sizes[i])) if sizes[i] > 0 and free > 0 else 0
            share[i] -= k
            free -= k * sizes[i]
        again = _fit(sizes, counts, budget, dense, list(share))
        best = max(best, again, key=words)
        back = max(1, back) * 4
    return best


def _fit(sizes: list[int], counts: list[int], budget: int, dense: int, take: list[int]) -> list[int]:
    left = budget - sum(s * t for s, t in zip(sizes, take, strict=True))
    by_size = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: -sizes[i])
    for i in by_size:
        if left > dense and sizes[i] <= left:
            k = min(counts[i] - take[i], -(-(left - dense) // sizes[i]), left // sizes[i])
            take[i] += k
            left -= k * sizes[i]
    items, masks, reach, mask = [], [], 1, (1 << (left + 1)) - 1
    for i in reversed(by_size):
        rest, step = min(counts[i] - take[i], left // sizes[i]), 1
        while rest > 0 and not reach >> left & 1:
            k = min(step, rest)
            masks.append(reach)
            items.append((i, k))
            reach |= reach << k * sizes[i] & mask
            rest, step = rest - k, step * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for (i, k), before in zip(reversed(items), reversed(masks), strict=True):
        if not before >> at & 1:
            take[i] += k
            at -= k * sizes[i]
    return take


def _plan(dense: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        sizes, counts = [int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]]
        target, total = int(pdf["words"].iloc[0]), int(pdf["source_size"].iloc[0])
        copies = min(target // total, 2) if total else 0
        more = fit_budget(sizes, counts, target - copies * total, dense) if copies < 2 else [0] * len(sizes)
        return pd.DataFrame({"k_source": pdf["source"].to_numpy(), "k_size": np.array(sizes, dtype="int64"), "copies": np.full(len(sizes), copies, dtype="int64"), "more": np.array(more, dtype="int64")})

    return plan


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 29, dense: int = 50_000) -> DataFrame:
    """One row per document: id, ``size`` (words), ``source_size``, ``target``, ``taken`` (words, repeats counted).

    Whole copies of a source come first; the remaining budget is fitted over the counts of its documents by
    exact length, and of each length the documents with the smallest seeded hash are taken. The driver holds one
    total per source; lengths and documents stay distributed, and no task holds all documents of a source.

    Null text and text without words: size 0, nothing taken. A null source is a source of its own, last in
    order. Repeated rows count each. An empty table gives an empty result. ``most`` other than 2 is refused.
    """
    if most != 2:
        raise ValueError("a document is taken at most twice")
    base = docs.select(F.col(id_col).alias(id_col), F.col(source_col).cast("string").alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"))
    base = materialize(base, "mix-base")
    spark = docs.sparkSession
    lengths = materialize(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    totals = {r["source"]: int(r["t"]) for r in lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("t")).collect()}
    targets = water_fill(totals, weights, share, most)
    rows = [(s, totals[s], float(t), math.floor(t)) for s, t in targets.items()]
    goal = spark.createDataFrame(rows, "g_source string, source_size long, target double, words long")
    plan = lengths.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).groupBy("source").applyInPandas(_plan(dense), "k_source string, k_size long, copies long, more long")
    plan = materialize(plan, "mix-plan")
    out = numbered(base, ["source", "size"], [id_col], "rank", seed, bits=6)
    out = out.join(plan, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")), "left")
    out = out.join(goal, F.col("source").eqNullSafe(F.col("g_source")), "left")
    taken = F.col("size") * (F.col("copies") + (F.col("rank") < F.col("more")).cast("long"))
    return out.select(id_col, "source", "size", "source_size", "target", taken.alias("taken"))
