"""Product codes of vectors: equal consecutive parts, a small codebook per part, a byte for each part of a vector.

Codebooks are learned by rounds of assignment and mean over all vectors. A round is one ``treeAggregate`` over blocks that
hold a few thousand vectors as a columnar NumPy array: within a task distances are added up dimension by dimension,
``np.add.at`` gathers int64 sums and counts, and these tensors (64 entries times the dimensions, whatever the number of
vectors) merge through a reduction tree. All arithmetic is on integers, so neither partitions nor merges change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.common import materialize

_LIMIT = (1 << 63) - 1


def part_edges(dim: int, parts: int) -> list[int]:
    """Where parts begin and end: equal if ``parts`` divides ``dim``, else as near as can be (some may be empty)."""
    return [dim * i // parts for i in range(parts + 1)]


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds a null or non-finite component.

    Components are kept within 2**24 of 0 (|x| of 65,536 at a scale of 256), so that squared distances of up to 4,096
    dimensions and sums over 2**39 vectors fit 64 bits."""
    real = vector.cast("array<double>")
    bad = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ends = float(1 << 24)
    return F.when(vector.isNotNull() & ~bad, F.transform(real, lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-ends)), F.lit(ends))).cast("int")))


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]`` (codes, width of part p) int64: the entries of part p."""

    entries: list[np.ndarray]
    dim: int
    scale: int

    def sha256(self) -> str:
        flat = np.concatenate([e.ravel() for e in self.entries]) if self.entries else np.zeros(0, dtype=np.int64)
        return hashlib.sha256(",".join(map(str, flat.tolist())).encode()).hexdigest()

    def assign(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part (ties to the lower index) and its squared distance, both (parts, vectors), of
        vectors given as (dim, vectors)."""
        n = columns.shape[1]
        which, far = np.zeros((len(self.entries), n), dtype=np.int64), np.zeros((len(self.entries), n), dtype=np.int64)
        edges = part_edges(self.dim, len(self.entries))
        for p, book in enumerate(self.entries):
            total = np.zeros((len(book), n), dtype=np.int64)
            for d in range(edges[p], edges[p + 1]):
                off = columns[d][None, :] - book[:, d - edges[p]][:, None]
                off *= off
                total += off
            which[p] = total.argmin(axis=0)
            far[p] = np.take_along_axis(total, which[p][None, :], axis=0)[0]
        return which, far


@dataclass
class Sums:
    """Sums and counts of the parts given to each entry."""

    sums: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def zero(cls, books: Codebooks) -> Sums:
        return cls([np.zeros_like(e) for e in books.entries], np.zeros((len(books.entries), max(map(len, books.entries))), dtype=np.int64))

    def add(self, columns: np.ndarray, books: Codebooks) -> Sums:
        which, _ = books.assign(columns)
        edges = part_edges(books.dim, len(books.entries))
        for p in range(len(self.sums)):
            np.add.at(self.sums[p], which[p], columns[edges[p] : edges[p + 1]].T)
            np.add.at(self.counts[p], which[p], 1)
        return self

    def merge(self, other: Sums) -> Sums:
        for mine, theirs in zip(self.sums, other.sums, strict=True):
            mine += theirs
        self.counts += other.counts
        return self

    def means(self, books: Codebooks) -> Codebooks:
        """Entries as the means of their parts, rounded down; an entry without a part stays."""
        new = [np.where(c[:, None] > 0, s // np.maximum(c, 1)[:, None], e) for s, c, e in zip(self.sums, self.counts[:, : len(books.entries[0])], books.entries, strict=True)]
        return Codebooks(new, books.dim, books.scale)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """(dim, vectors) of a list column whose lists all have ``dim`` numbers."""
    return np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).T.astype(np.int64))


def _blocks(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = np.ascontiguousarray(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).T.astype("<i4"))
                yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64()), "block": pa.array([flat.tobytes()], pa.binary())})

    return run


def _columns(block: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(block, dtype="<i4").reshape(dim, n).astype(np.int64)


def _kept(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    return vectors.select(F.col(f"`{id_col}`").alias("id"), floored(F.col(f"`{vec_col}`"), scale).alias("v")).where("v is not null")


def fit_codebooks(vectors: DataFrame, parts: int = 16, codes: int = 64, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> Codebooks:
    """Codebooks of ``parts`` parts with ``codes`` entries each (256 at most), after ``rounds`` rounds over all vectors.

    They start as the parts of the vectors with the smallest ids (rows without an id last, equal ids by vector), of which
    there may be fewer than ``codes``. Vectors that are null or hold null or non-finite components take no part, nor do
    those of another dimension than the first one's. Without any vector there are no entries. Only ``codes`` vectors and
    one tensor of sums a round come to the driver.
    """
    if not 1 <= codes <= 256:
        raise ValueError(f"codes must be 1 to 256, not {codes}")
    kept = _kept(vectors, id_col, vec_col, scale)
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).limit(codes).collect()
    if not first:
        return Codebooks([], 0, scale)
    dim = len(first[0]["v"])
    kept = kept.where(F.size("v") == dim)
    if any(len(r["v"]) != dim for r in first):
        first = kept.orderBy(*order).limit(codes).collect()
    seeds = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), dim)
    edges = part_edges(dim, parts)
    books = Codebooks([seeds[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)], dim, scale)
    spark = kept.sparkSession
    blocks = materialize(kept.select("v").mapInArrow(_blocks(dim), "n long, block binary"), "codes-blocks") if rounds and dim else None
    for _ in range(rounds if dim else 0):
        sent = spark.sparkContext.broadcast(books)

        def add(acc: Sums | None, row, sent=sent) -> Sums:
            return (acc or Sums.zero(sent.value)).add(_columns(row["block"], row["n"], sent.value.dim), sent.value)

        def merge(a: Sums | None, b: Sums | None) -> Sums | None:
            return a.merge(b) if a and b else a or b

        total = blocks.rdd.treeAggregate(None, add, merge, depth=2)
        books = total.means(books)
        sent.unpersist()
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """``id, code, error`` (and ``label``) of every vector that the codebooks fit: two hex digits for each part's nearest
    entry, and the squared distances to them, summed. Repeated rows are coded each; an empty table, or codebooks without
    an entry, give no rows. Other columns are ignored."""
    kept = _kept(vectors, id_col, vec_col, books.scale) if label_col is None else vectors.select(F.col(f"`{id_col}`").alias("id"), floored(F.col(f"`{vec_col}`"), books.scale).alias("v"), F.col(f"`{label_col}`").alias("label")).where("v is not null")
    kept = kept.where((F.size("v") == books.dim) & F.lit(bool(books.entries)))
    others = [c for c in kept.columns if c != "v"]
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = sent.value
            which, far = own.assign(_matrix(b.column("v"), own.dim) if own.dim else np.zeros((0, b.num_rows), dtype=np.int64))
            code = [row.tobytes().hex() for row in which.T.astype(np.uint8)]
            yield pa.record_batch({**{c: b.column(c) for c in others}, "code": pa.array(code, pa.string()), "error": pa.array(far.sum(axis=0), pa.int64())})

    schema = ", ".join([*(f"{c} {kept.schema[c].dataType.simpleString()}" for c in others), "code string", "error long"])
    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """Adds ``decoded``: the vector that a code stands for, in the vectors' own units (the middle of what an integer
    covers). A null code gives null."""
    sent = coded.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def of(code: pd.Series) -> pd.Series:
        own = sent.value

        def one(text: str | None) -> np.ndarray | None:
            return None if text is None else (np.concatenate([e[i] for e, i in zip(own.entries, bytes.fromhex(text), strict=True)]) + 0.5) / own.scale

        return code.map(one)

    return coded.withColumn("decoded", of(F.col(f"`{code_col}`")))


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: the errors summed over equal labels, null ones together. Errors are summed by label before
    they meet the rows, so a label that most rows have is no larger task; beyond 64 bits the sum is the largest number
    that fits."""
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LIMIT).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
