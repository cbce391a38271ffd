"""Exact top-k inner-product search by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventspark.llm.common import materialize

_HITS = "query_id long, vec_id long, score long"
#: Floor of a query that has not k scores yet.
_NONE = -1e300


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, within 2**62 of 0; null if the vector is null or holds a null or non-finite
    component."""
    real = vector.cast("array<double>")
    bad = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(real, lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-(2.0**62))), F.lit(2.0**62))).cast("long")))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where every partial sum is below 2**53, else in Python integers, which end at
    the limits of 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    big = a.astype(object) @ b.astype(object).T
    return np.clip(big, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


class Bucket:
    """Vectors of nearly one length, ordered by length. ``focus`` are the coordinates with the largest energy, ``rest``
    is the length of each vector without them."""

    GROUP = 128  # queries of similar need that are multiplied together
    PROBES = 256  # vectors of the prefix that the choice of pruning looks at

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, n_focus: int = 8) -> None:
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norm))
        self.ids, self.v, self.norm = ids[order], vectors[order], norm[order]
        energy = (self.v.astype(np.float64) ** 2).sum(axis=0)
        self.focus = np.argsort(-energy, kind="stable")[:n_focus]
        rest = np.setdiff1d(np.arange(self.v.shape[1]), self.focus)
        self.rest = np.sqrt((self.v[:, rest].astype(np.float64) ** 2).sum(axis=1))
        self.cut_by_length = self.cut_by_coordinate = 0

    def search(self, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: the candidates of this bucket that can reach its floor, at most the best k with ties by
        id. Only the prefix of vectors long enough for some query is looked at (length pruning). Where a query's local
        cosine threshold floor / (|q| |v|) is high enough that the focus coordinates exclude vectors, partial products
        with a Cauchy-Schwarz bound of the rest prune within the prefix (coordinate pruning): a spread sample of the
        prefix tells what share would be left, and it is done where that share and the partial products cost less than
        all products. ``cut_by_length`` and ``cut_by_coordinate`` count the pairs that were not multiplied."""
        if not len(self.ids) or not len(q_ids):
            return
        qn = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        needs = (floor - 1e-6) / np.maximum(qn, 1e-9)
        order = np.argsort(needs, kind="stable")
        for part in np.array_split(order, -(-len(order) // self.GROUP)):
            n = int(np.searchsorted(-self.norm, -(needs[part[0]] * (1 - 1e-9)) + 1e-6, side="right")) if needs[part[0]] > 0 else len(self.ids)
            self.cut_by_length += len(part) * (len(self.ids) - n)
            if not n:
                continue
            step = -(-n // self.PROBES)
            left = self._may(q[part], floor[part], slice(0, n, step)).mean(axis=1)
            cheap = left + len(self.focus) / self.v.shape[1] < 0.75
            for sub, prune in ((part[~cheap], False), (part[cheap], True)):
                if not len(sub):
                    continue
                cols = np.arange(n)
                if prune:
                    cols = np.flatnonzero(self._may(q[sub], floor[sub], slice(0, n)).any(axis=0))
                    self.cut_by_coordinate += len(sub) * (n - len(cols))
                yield from self._verified(q[sub], sub, q_ids, floor, cols, k)

    def _may(self, q: np.ndarray, floor: np.ndarray, at: slice) -> np.ndarray:
        """Whether the product of each query with each vector of ``at`` can reach the floor, by the focus coordinates."""
        q, v, r = q.astype(np.float64), self.v[at].astype(np.float64), self.rest[at]
        out = np.ones(q.shape[1], dtype=bool)
        out[self.focus] = False
        bound = q[:, self.focus] @ v[:, self.focus].T
        size = np.sqrt((q[:, self.focus] ** 2).sum(axis=1))[:, None] * np.sqrt((v[:, self.focus] ** 2).sum(axis=1))[None, :]
        bound += np.sqrt((q[:, out] ** 2).sum(axis=1))[:, None] * r[None, :] * (1 + 1e-9) + size * 1e-12 + 1e-6
        return bound >= floor[:, None]

    def _verified(self, q: np.ndarray, at: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, cols: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not len(cols):
            return
        ids = self.ids[cols]
        for i, row in zip(at, _exact(q, self.v[cols]), strict=True):
            hit = np.flatnonzero((row >= floor[i]) & (ids != q_ids[i]))
            if len(hit) > k:
                hit = hit[np.lexsort((ids[hit], -row[hit]))[:k]]
            if len(hit):
                yield int(i), ids[hit], row[hit]


def _matrix(lists: pd.Series) -> np.ndarray:
    return np.stack(lists.to_numpy()).astype(np.int64) if len(lists) else np.zeros((0, 0), dtype=np.int64)


def _cell(k: int):
    """One query block against one bucket: rows with ``is_q`` are queries (with a floor), the others candidates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["is_q"]], pdf[~pdf["is_q"]]
        out: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(c):
            ids = q["id"].to_numpy(dtype=np.int64)
            for i, who, score in Bucket(c["id"].to_numpy(dtype=np.int64), _matrix(c["v"])).search(_matrix(q["v"]), ids, q["floor"].to_numpy(dtype=np.float64), k):
                out.append((np.full(len(who), ids[i]), who, score))
        if not out:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, bucket_rows: int = 4096, query_rows: int = 2048, bands: int = 64, seed: int = 41) -> DataFrame:
    """For each query row: ``query_id, rank, vec_id, score`` of the k highest integer inner products with every row
    but itself, ties to the smaller id; all of them if there are fewer.

    Vectors are bucketed by length (bands of the norm, each dealt into buckets of about ``bucket_rows``). A first pass
    against a seeded sample of the vectors gives each query a floor: the k-th best score it already has. Queries are
    put in bands by floor / |q|, the least length that can reach the floor, and dealt into blocks. The second pass
    sends a vector only to the blocks whose band its own band's greatest length reaches, and a block only to the
    buckets long enough for it; within a cell the floors prune again, and the rest is verified, so the result is exact.
    A cell is bounded on both sides; only the edges of at most ``bands`` + ``bands`` bands come to the driver.

    An empty table gives an empty result, other columns are ignored. Scores beyond 64 bits are the nearest number that
    fits. Null vectors, those with null or non-finite components, rows without an id, and vectors of another dimension
    than the query's take no part with it. Repeated rows are one candidate each, except that rows with the query's own id are
    never its candidates; of several vectors of one id in a dimension, the least in order of components asks.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    rows = rows.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    rows = materialize(rows, "topk-rows")
    stats = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("nq"), F.sum("norm").alias("s"), F.min("norm").alias("lo"), F.max("norm").alias("hi")).collect()
    results = []
    for st in stats:
        own = rows.where(F.col("dim") == st["dim"])
        if not st["nq"]:
            continue
        edges = _edges(own, "norm", min(bands, -(-st["n"] // (bucket_rows * 8))))
        split = max(1, -(-st["n"] // ((len(edges) + 1) * bucket_rows)))
        cand = own.select("id", "v", _band(F.col("norm"), edges).alias("band"), _dealt("id", seed, split).alias("part"))
        asks = own.where("asks").groupBy("id").agg(F.min_by("v", "v").alias("v"), F.min_by("norm", "v").alias("norm"))
        n_blocks = max(1, -(-st["nq"] // query_rows))
        # A quarter of the rows at most: a first pass over all of them would be the search itself.
        share = int((1 << 20) * min(0.25, 4.0 * bucket_rows / st["n"]))
        sample = cand.where(F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(1 << 20)) < share).select("id", "v", F.lit(0).alias("bucket"), F.lit(n_blocks - 1).alias("last"))
        first = asks.select("id", "v", F.lit(_NONE).alias("floor"), F.lit(0).alias("first"), _dealt("id", seed + 1, n_blocks).alias("block"))
        floors = _best(_cells(sample, first, 1, k), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("m"))
        floors = floors.where(F.col("c") >= k).select("query_id", F.col("m").cast("double").alias("floor"))
        known = asks.join(floors, asks["id"] == floors["query_id"], "left").select("id", "v", F.coalesce("floor", F.lit(_NONE)).alias("floor"), "norm")
        known = materialize(known.withColumn("reach", (F.col("floor") - 1e-6) / F.greatest("norm", F.lit(1e-9))), "topk-known")
        q_edges = _edges(known, "reach", min(bands, n_blocks))
        q_split = max(1, -(-n_blocks // (len(q_edges) + 1)))
        # Band i of the vectors ends at tops[i], band j of the queries begins at starts[j]; both ascend.
        tops = [t * (1 + 1e-9) + 1e-6 for t in [*edges, st["hi"]]]
        starts = [known.agg(F.min("reach")).first()[0], *q_edges]
        last = [sum(s <= t for s in starts) * q_split - 1 for t in tops]
        least = [sum(t < s for t in tops) * split for s in starts]
        blocks = known.withColumn("qband", _band(F.col("reach"), q_edges))
        blocks = blocks.select("id", "v", "floor", F.element_at(_ints(least), F.col("qband") + 1).alias("first"), (F.col("qband") * q_split + _dealt("id", seed + 1, q_split)).cast("int").alias("block"))
        cand = cand.select("id", "v", (F.col("band") * split + F.col("part")).cast("int").alias("bucket"), F.element_at(_ints(last), F.col("band") + 1).alias("last"))
        results.append(_cells(cand, blocks, len(tops) * split, k))
    if not results:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = results[0]
    for r in results[1:]:
        hits = hits.unionByName(r)
    return _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _edges(df: DataFrame, col: str, n: int) -> list[float]:
    """At most n - 1 ascending values of ``col`` that cut the rows into nearly equal bands."""
    return sorted(set(df.approxQuantile(col, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _band(value: Column, edges: list[float]) -> Column:
    """How many edges lie below the value."""
    return reduce(lambda a, e: a + (value > e).cast("int"), edges, F.lit(0))


def _dealt(id_col: str, seed: int, n: int) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(n)).cast("int")


def _cells(cand: DataFrame, asks: DataFrame, n_buckets: int, k: int) -> DataFrame:
    """Query blocks meet buckets, a pair in one task: vectors go to the blocks up to ``last``, queries to the buckets
    from ``first`` on."""
    none = F.array().cast("array<int>")
    to = F.when(F.col("last") >= 0, F.sequence(F.lit(0), F.col("last"))).otherwise(none)
    c = cand.select(F.lit(False).alias("is_q"), "id", "v", F.lit(0.0).alias("floor"), "bucket", F.explode(to).alias("block"))
    to = F.when(F.col("first") < n_buckets, F.sequence(F.col("first"), F.lit(n_buckets - 1))).otherwise(none)
    q = asks.select(F.lit(True).alias("is_q"), "id", "v", "floor", F.explode(to).alias("bucket"), "block")
    return c.unionByName(q).groupBy("bucket", "block").applyInPandas(_cell(k), _HITS)
