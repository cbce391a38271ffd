"""Gapless numbering, within keys or in order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventspark.sources.scratch import materialize


def numbered(df: DataFrame, keys: list[str], ids: list[str], out: str, seed: int, bits: int = 12) -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... without gaps within ``keys``, in the order of a seeded hash of ``ids``.

    Rows are ranked within (key, leading ``bits`` of the hash), and the start of each such chunk comes from the chunk
    counts. Null keys form a group of their own.
    """
    h, chunk, start, rank = (f"__{x}_{out}" for x in ("h", "chunk", "start", "rank"))
    df = df.withColumn(h, F.xxhash64(F.lit(seed), *ids)).withColumn(chunk, F.shiftrightunsigned(F.col(h), 64 - bits))
    counts = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(chunk).alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(*keys, chunk).orderBy(h, *ids)
    ranked = df.withColumn(rank, F.row_number().over(within) - 1)
    on = F.col(chunk) == F.col("__c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = ranked.join(starts, on, "left")
    return joined.withColumn(out, (F.col(start) + F.col(rank)).cast("long")).drop(h, chunk, start, rank, "__c", *[f"__k{i}" for i in range(len(keys))])


def ordered(df: DataFrame, by: list[Column], out: str, label: str = "ordered") -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... over the whole table in the order of ``by`` (nulls first unless a column says
    otherwise; ties get numbers of their own, in input order).

    Spark samples splitters and deals the rows into ranges between them; each row is marked with its range and its place
    within it, and the sizes of the ranges before it are added. The marked rows are written once, so that both steps see
    the same ranges. No task holds more than one range, and rows that are equal in ``by`` can be split. The table of
    range sizes has a row per range, so it is broadcast.
    """
    mark, tie, part, before = (f"__ordered_{x}" for x in ("mark", "tie", "part", "before"))
    df = df.withColumn(tie, F.monotonically_increasing_id())
    placed = df.repartitionByRange(*by, tie).sortWithinPartitions(*by, tie).drop(tie).withColumn(mark, F.monotonically_increasing_id())
    placed = materialize(placed, label).withColumn(part, F.shiftright(mark, 33))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias(before))
    rank = F.col(before) + F.col(mark).bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(sizes), part).withColumn(out, rank).drop(mark, part, before)
