"""Merkle manifests of tables: one digest over every row, a proof for each row, checks of rows against their proofs.

Rows are the leaves of one tree per group, the groups' roots the leaves of a tree above. A tree is reduced in
superblocks: a bucket of fanout ** levels consecutive nodes is collapsed by as many levels in one task, its root is a node
of the next round, and so on until each tree has one node. Proofs go the other way: a bucket's own path upward is made
once and handed to its members, who put the levels within the bucket before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.common import materialize, ordered

_NODE = "tree long, idx long, n long, digest string"
_PATH = "lefts array<string>, rights array<string>, subroot string, root string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the values, each with its length in front, so that no two rows share one text: ``-`` for
    null, else the UTF-8 bytes of the value as text, ``:`` and that text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass(frozen=True)
class Shape:
    fanout: int = 16
    #: Levels that a task collapses; a bucket holds fanout ** levels nodes at most.
    levels: int = 3

    @property
    def width(self) -> int:
        return self.fanout**self.levels

    def collapse(self, digests: list[str], n: int) -> list[list[str]]:
        """The nodes of a bucket, level by level up to one root. ``n``: nodes of its whole tree at the bucket's height.
        A tree that ends within the bucket has no further levels; any other gets all of them, runs of one included."""
        out = [digests]
        while len(out[-1]) > 1 or n > self.width and len(out) <= self.levels:
            out.append([sha("".join(out[-1][i : i + self.fanout])) for i in range(0, len(out[-1]), self.fanout)])
        return out

    def paths(self, levels: list[list[str]]) -> Iterator[tuple[list[str], list[str]]]:
        """For each node of the lowest level: its siblings to the left and to the right on each level, joined."""
        of: list[tuple[list[str], list[str]]] = [([], [])]
        for nodes in reversed(levels[:-1]):
            below = []
            for up, start in enumerate(range(0, len(nodes), self.fanout)):
                run = nodes[start : start + self.fanout]
                below += [(["".join(run[:i]), *of[up][0]], ["".join(run[i + 1 :]), *of[up][1]]) for i in range(len(run))]
            of = below
        yield from of


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf has by its siblings."""
    for a, b in zip(lefts, rights, strict=True):
        digest = sha(a + digest + b)
    return digest


def _root_of(shape: Shape) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n = int(pdf["n"].iloc[0])
        top = shape.collapse(list(pdf["digest"]), n)[-1][0]
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "idx": pdf["bucket"].iloc[:1], "n": -(-n // shape.width), "digest": top})

    return run


def _placed(nodes: DataFrame, shape: Shape) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"idx div {shape.width}"))


def reduce_trees(nodes: DataFrame, shape: Shape) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of all trees at once: ``nodes`` (tree, idx, n, digest), then the bucket roots of each round, of
    trees that have more than one; and (tree, digest) of each tree's last node. Rounds grow with the logarithm of the
    largest tree; only its size comes to the driver."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops, now = [nodes], [nodes.where("n = 1").select("tree", "digest")], nodes.where("n > 1")
    while most > 1:
        roots = materialize(_placed(now.select("tree", "idx", "n", "digest"), shape).groupBy("tree", "bucket").applyInPandas(_root_of(shape), _NODE), "merkle-roots")
        tops.append(roots.where("n = 1").select("tree", "digest"))
        now, most = roots.where("n > 1"), -(-most // shape.width)
        if most > 1:
            levels.append(now)
    return levels, reduce(DataFrame.unionByName, tops)


def _handed_down(shape: Shape, make: Callable[[pd.DataFrame, list], pd.DataFrame], names: list[str]):
    """The members of a bucket get their paths: levels within the bucket, then the bucket's own path."""

    def run(members: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        members, up = members.sort_values("idx"), above.iloc[0]
        lefts, rights = list(up["lefts"]), list(up["rights"])
        inner = shape.collapse(list(members["digest"]), int(members["n"].iloc[0]))
        out = make(members, [(a + lefts, b + rights) for a, b in shape.paths(inner)])
        return out.assign(subroot=up["subroot"], root=up["root"])[names]

    return run


def _whole(members: pd.DataFrame, paths: list) -> pd.DataFrame:
    return members.assign(lefts=[a for a, _ in paths], rights=[b for _, b in paths])


def _digested(members: pd.DataFrame, paths: list) -> pd.DataFrame:
    """Digests of the proofs, and the root that the presented row has by its proof."""
    proofs = [sha("".join(x for pair in zip(a, b, strict=True) for x in pair)) for a, b in paths]
    return members.assign(proof_sha256=proofs, folded_root=[fold(d, a, b) for d, (a, b) in zip(members["claimed"], paths, strict=True)])


def hand_down(levels: list[DataFrame], tops: DataFrame, shape: Shape, schema: str, make) -> DataFrame:
    """Paths of all nodes of ``levels[0]``. ``tops`` (tree, of, lefts, rights, subroot, root): each tree's number of
    leaves and the path above its root. A bucket meets one row, the path of its root, so no path is copied to a
    bucket's rows before it is used."""
    paths = None
    for r in reversed(range(len(levels))):
        n = F.expr(f"(of + {shape.width**r - 1}) div {shape.width**r}")
        own = tops.where((n <= shape.width) & ((n > 1) | F.lit(r == 0))).select("tree", F.lit(0).cast("long").alias("bucket"), *_cols(_PATH))
        above = own if paths is None else own.unionByName(paths.select("tree", F.col("idx").alias("bucket"), *_cols(_PATH)))
        form, how = (schema, make) if r == 0 else (f"{_NODE}, {_PATH}", _whole)
        out = _placed(levels[r], shape).groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket")).applyInPandas(_handed_down(shape, how, _cols(form)), form)
        paths = materialize(out, "merkle-paths") if r else out
    return paths


def _cols(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class Manifest:
    """``leaves`` (tree, idx, n, id, digest, claimed), ``groups`` (tree, group, n), the trees' levels, and ``tops``."""

    shape: Shape
    leaves: DataFrame
    groups: DataFrame
    levels: list[DataFrame]
    tops: DataFrame
    id_type: str

    def root(self) -> str | None:
        """The digest over the whole table; None if it has no row."""
        row = self.tops.select("root").first()
        return row[0] if row else None

    def proofs(self) -> DataFrame:
        """id, leaf, and the proof itself: ``lefts`` and ``rights`` hold the siblings on each level from the leaf to the
        root, joined, so that ``fold(leaf, lefts, rights)`` is the root."""
        out = hand_down(self.levels, self.tops, self.shape, f"id string, digest string, {_PATH}", _whole)
        return self._ids(out).withColumnRenamed("digest", "leaf")

    def audit(self) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256, folded_root, verified: each presented row against its proof."""
        form = "id string, digest string, proof_sha256 string, folded_root string, subroot string, root string"
        out = hand_down(self.levels, self.tops, self.shape, form, _digested)
        return self._ids(out).withColumnRenamed("digest", "leaf").withColumn("verified", F.col("folded_root") == F.col("root"))

    def _ids(self, out: DataFrame) -> DataFrame:
        return out.withColumn("id", F.col("id").cast(self.id_type))


def build(rows: DataFrame, columns: list[str], group_col: str, id_col: str, claimed: Column | None = None, shape: Shape | None = None) -> Manifest:
    """The manifest of ``rows`` over ``columns``. ``claimed`` is the digest of the row that is presented for a check
    later (``leaf`` of changed values); by default the row itself.

    Per value of ``group_col`` leaves ascend by ``id_col`` (null first, equal ids by digest; rows equal in all are leaves
    of their own). Groups ascend as bytes, null first. Nulls in any column, empty and very long texts are values as any;
    an empty table has no root and no proofs. Columns that are not named take no part, so their names may clash. A group
    may hold most rows: positions come from ranges of a sorted table, buckets from positions.
    """
    shape = shape or Shape()
    own = leaf([F.col(f"`{c}`") for c in columns])
    flat = rows.select(F.col(f"`{group_col}`").alias("group"), F.col(f"`{id_col}`").alias("key"), own.alias("digest"), (own if claimed is None else claimed).alias("claimed"))
    # Written before it is sorted: the sort samples its input, and texts would be hashed for that a second time.
    placed = ordered(materialize(flat, "merkle-leaves"), [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest")], "at", "merkle-sorted")
    groups = placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    groups = materialize(ordered(groups, [F.col("first")], "tree", "merkle-groups"), "merkle-trees")
    joined = placed.alias("l").join(groups.alias("r"), F.col("l.group").eqNullSafe(F.col("r.group")))
    leaves = joined.select("tree", (F.col("at") - F.col("first")).alias("idx"), "n", F.col("key").cast("string").alias("id"), "digest", "claimed")
    levels, subroots = reduce_trees(leaves, shape)
    n = groups.count()
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("n"), "digest")
    over = materialize(over, "merkle-subroots")
    upper, roots = reduce_trees(over, shape)
    none = F.array().cast("array<string>")
    top = roots.select("tree", F.lit(n).cast("long").alias("of"), none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = materialize(hand_down(upper, top, shape, f"{_NODE}, {_PATH}", _whole), "merkle-paths")
    tops = paths.select(F.col("idx").alias("tree"), "lefts", "rights", F.col("digest").alias("subroot"), "root").join(groups.select("tree", F.col("n").alias("of")), "tree")
    return Manifest(shape, leaves, groups.select("tree", "group", "n"), levels, tops, dict(rows.dtypes)[id_col])
