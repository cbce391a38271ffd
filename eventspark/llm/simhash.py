"""SimHash fingerprints of texts and the groups of texts whose fingerprints differ in few bits.

Distinct fingerprints are put into the upper nodes of an index: a node is a mask and the pattern that its members share
under it. Fingerprints that differ in at most ``most`` bits agree on two of ``most + 2`` blocks of their bits, so the masks
of all pairs of blocks bring each of them together. A node with too many members is split the same way over the bits that
are still free; sixteen free bits hold at most 65,536 distinct fingerprints, so this ends, and no node needs a cap. Below
a node its members are sorted by Gray rank, in which neighbours differ in few bits; runs of them become inner nodes, each
with the bits that all its members share, and pairs of nodes are followed down only while their shared bits differ in at
most ``most`` places.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.common import bound_batches, materialize
from eventspark.llm.components import connected_components

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_ALL = (1 << 64) - 1
#: Nodes of one level under one node of the next.
_FAN = 8


def fingerprint(text: bytes | None, k: int = 3, seed: int = 42) -> int:
    """Bits set in more than half of the XXH64 hashes of the text's k-word shingles, repeats included; a text of fewer
    words is one shingle, one without words has no bit set."""
    words = (text or b"").translate(_LOWER).split()  # bytes split at space and U+0009 to U+000D alone
    if not words:
        return 0
    size, step, bits = min(k, len(words)), 1 << 16, np.zeros(64, dtype=np.int64)
    n = len(words) - size + 1
    for at in range(0, n, step):  # a very long text has a bounded number of hashes at a time
        shingles = map(b" ".join, zip(*(words[at + j : min(n, at + step) + j] for j in range(size)), strict=True))
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """``id, fp`` (64 bits as a long) of every row. A null text has no words."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, k, seed) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch({"id": b.column("id"), "fp": pa.array(found, pa.int64())})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the order of the Gray code, as a long that sorts as this place (unsigned) does."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def sharing_masks(free: int, most: int) -> list[int]:
    """Masks of the pairs of ``most + 2`` nearly equal blocks of the free bits: two numbers that differ in at most
    ``most`` of these bits agree under one of them."""
    bits = [b for b in range(64) if free >> b & 1]
    n = most + 2
    blocks = [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]
    return sorted({a | b for a, b in combinations(blocks, 2)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class GrayIndex:
    """Distinct fingerprints in Gray order under a tree of runs. Level 0 are the fingerprints themselves; a node of level
    i covers ``fan`` nodes of level i - 1 and knows ``mask``, the bits that all below it share, and ``pattern``, their
    values."""

    def __init__(self, fps: np.ndarray, fan: int = _FAN) -> None:
        self.fps, self.fan = fps, fan
        self.levels = [(np.full(len(fps), _ALL, dtype=np.uint64), fps)]
        while len(self.levels[-1][1]) > fan:
            mask, pattern = self.levels[-1]
            starts = np.arange(0, len(pattern), fan)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ first), starts)
            self.levels.append((shared, pattern[starts] & shared))
        self.compared = 0

    def pairs(self, most: int, chunk: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i < j) of all fingerprints that differ in at most ``most`` bits, found from the top: a pair of nodes
        goes down if the bits that both share differ in no more. Pairs are followed depth first in pieces of ``chunk``,
        so that few are held at a time."""
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][1]))
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > chunk:
                stack += [(level, i[a : a + chunk], j[a : a + chunk]) for a in range(0, len(i), chunk)]
                continue
            mask, pattern = self.levels[level]
            self.compared += len(i)
            near = _ones((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= most
            i, j = i[near], j[near]
            if not level:
                keep = i < j
                if keep.any():
                    yield i[keep], j[keep]
            elif len(i):
                n, f = len(self.levels[level - 1][1]), self.fan
                a = (i[:, None] * f + np.repeat(np.arange(f), f)[None, :]).ravel()
                b = (j[:, None] * f + np.tile(np.arange(f), f)[None, :]).ravel()
                real = (a < n) & (b < n) & (a <= b)
                stack.append((level - 1, a[real], b[real]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of n positions is connected to; pairs are used piece by piece and not kept."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _linked(most: int):
    """Members of nodes, a node's rows one after another and in Gray order, to links between each and the smallest of
    those it is connected with inside the node."""

    def links(fps: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        starts = np.append(0, ends[:-1])
        size = ends - starts
        node = np.repeat(np.arange(len(size)), size)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for d in range(1, _FAN):  # a node of one run is compared as a whole, all such nodes together
                i = np.flatnonzero((node[:-d] == node[d:]) & (size[node[:-d]] <= _FAN)) if len(node) > d else np.zeros(0, dtype=np.int64)
                i = i[_ones(fps[i] ^ fps[i + d]) <= most]
                yield i, i + d
            for at in np.flatnonzero(size > _FAN):
                for i, j in GrayIndex(fps[starts[at] : ends[at]]).pairs(most):
                    yield i + starts[at], j + starts[at]

        root = _roots(len(fps), pairs())
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return pa.record_batch({"u": pa.array(fps[moved].view(np.int64), pa.int64()), "v": pa.array(fps[root[moved]].view(np.int64), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 3
        for b in batches:
            rest = [np.concatenate([r, b.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("mask", "key", "fp"), strict=True)]
            ends = np.flatnonzero((np.diff(rest[0]) != 0) | (np.diff(rest[1]) != 0)) + 1
            if len(ends):  # the last node may go on in the next batch
                yield links(rest[2][: ends[-1]].view(np.uint64), ends)
                rest = [x[ends[-1] :] for x in rest]
        if len(rest[2]):
            yield links(rest[2].view(np.uint64), np.array([len(rest[2])]))

    return run


def near_links(fps: DataFrame, most: int = 2, capacity: int = 1 << 16) -> DataFrame:
    """(u, v): links between distinct fingerprints of ``fps`` (fp long, each once) that connect all that differ in at most
    ``most`` bits, if need be over others. Within a node only a spanning forest is given, so links grow with the rows.

    A node of more than ``capacity`` members is split further as long as more than sixteen of its bits are free, which
    hold 65,536 distinct fingerprints at most; so no node is capped, and rounds are as many as bits allow.
    """
    found, todo = [], [(fps, _ALL)]
    while todo:
        after = []
        for rows, free in todo:
            taken, masks = _ALL & ~free, sharing_masks(free, most)
            splits = [_signed(m | taken) for m in masks if (free & ~m).bit_count() > 16]
            keyed = rows.select("fp", F.explode(F.array(*[F.lit(_signed(m | taken)) for m in masks])).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
            sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            sizes = materialize(sizes.withColumn("large", (F.col("n") > capacity) & F.col("mask").isin(splits)), "simhash-nodes")
            found.append(_within(keyed, sizes.where("not large"), most))
            large = {r["mask"] for r in sizes.where("large").select("mask").distinct().collect()}
            for m in masks:
                if (mask := _signed(m | taken)) in large:
                    own = sizes.where(F.col("large") & (F.col("mask") == mask)).select("mask", "key")
                    after.append((keyed.join(own, ["mask", "key"], "left_semi").select("fp"), free & ~m))
        todo = after
    return reduce(DataFrame.unionByName, found)


def _within(keyed: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Links within the nodes. Rows are dealt by node after the join, which may split a node's rows."""
    rows = keyed.join(nodes.select("mask", "key"), ["mask", "key"], "left_semi").withColumn("rank", gray_rank(F.col("fp")))
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "rank")
    return dealt.select("mask", "key", "fp").mapInArrow(_linked(most), "u long, v long")


def near_groups(docs: DataFrame, most: int = 2, k: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component_id`` of every row: the smallest id that is reachable over fingerprints that differ in at most
    ``most`` bits, its own included.

    Texts that are null or without words share the fingerprint 0. Rows without an id belong to their group but give it
    no id (null if no row of it has one). Repeated rows and rows of one id with several texts each have a row; equal
    fingerprints are one node, so copies are never paired. An empty table gives an empty result, other columns are
    ignored, very long texts are hashed in pieces.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, k, seed), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    comps = connected_components(near_links(distinct.select("fp"), most))
    named = materialize(distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", "low", F.coalesce("comp", "fp").alias("comp")), "simhash-comps")
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    of = materialize(named.join(lows, "comp").select(F.col("fp").alias("of"), "component_id"), "simhash-groups")
    return rows.join(of, F.col("fp") == F.col("of")).select("id", "fp", "component_id")
