"""Splits and shards of subjects."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.functions.numbering import numbered

#: Fractions where none are given.
FRACTIONS = {"train": 0.8, "tuning": 0.1, "held_out": 0.1}


def split_sizes(n: int, fracs: dict[str, float | None]) -> dict[str, int]:
    """Subjects of each split by the largest remainder; splits with a null fraction don't take part. Every other split
    gets a subject, taken from whichever split has most."""
    exact = {k: Fraction(v).limit_denominator(10**9) * n for k, v in fracs.items() if v is not None}
    if abs(sum(exact.values()) - n) > Fraction(n, 10**8):
        raise ValueError(f"The fractions of the splits sum to {float(sum(exact.values()) / max(n, 1)):g}, not 1: {fracs}")
    if n < len(exact):
        raise ValueError(f"{n} subjects can't fill {len(exact)} splits")
    sizes = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: sizes[k] - exact[k])[: n - sum(sizes.values())]:
        sizes[k] += 1
    for k in [k for k, v in sizes.items() if not v]:
        sizes[max(sizes, key=sizes.__getitem__)] -= 1
        sizes[k] = 1
    return sizes


def shard_subjects(subjects: DataFrame, splits: DataFrame | None = None, fracs: dict[str, float | None] | None = None, n_subjects_per_shard: int = 50_000, seed: int = 1) -> DataFrame:
    """(subject_id, split, shard): given splits are kept, other subjects are dealt by ``fracs`` (80, 10 and 10 % if not
    given) in a seeded hash order; each split is cut into shards of at most ``n_subjects_per_shard``, sizes at most
    one apart."""
    ids = subjects.select("subject_id").where(F.col("subject_id").isNotNull()).distinct()
    given = splits.select("subject_id", "split").distinct() if splits is not None else ids.sparkSession.createDataFrame([], "subject_id long, split string")
    placed = given.join(ids, "subject_id", "left_semi")
    rest = ids.join(given, "subject_id", "left_anti")
    if n := rest.count():
        cut, split = 0, F.lit(None).cast("string")
        for name, size in reversed(list(split_sizes(n, FRACTIONS if fracs is None else fracs).items())):
            split = F.when(F.col("__r") < n - cut, F.lit(name)).otherwise(split) if cut else F.lit(name)
            cut += size
        placed = placed.unionByName(numbered(rest, [], ["subject_id"], "__r", seed).select("subject_id", split.alias("split")))
    counts = placed.groupBy("split").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("split", "__s")
    ranked = numbered(placed, ["split"], ["subject_id"], "__r", seed + 1).join(counts, F.col("split") == F.col("__s"))
    k = F.ceil(F.col("__n") / n_subjects_per_shard)
    q, r = F.floor(F.col("__n") / k), F.col("__n") % k
    big = r * (q + 1)
    shard = F.when(F.col("__r") < big, F.floor(F.col("__r") / (q + 1))).otherwise(r + F.floor((F.col("__r") - big) / q))
    return ranked.select("subject_id", "split", shard.cast("int").alias("shard"))


def reshard_to_split(df: DataFrame, splits: DataFrame | None = None, n_subjects_per_shard: int = 50_000, split_fracs: dict[str, float | None] | None = None, seed: int = 1) -> DataFrame:
    """The events with their ``split`` and ``shard``; ``sources.tables.write_events`` writes them apart."""
    return df.join(shard_subjects(df, splits, split_fracs, n_subjects_per_shard, seed), "subject_id")
