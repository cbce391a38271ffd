"""Filters by subject, by code metadata and by regex."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventspark.functions.blocks import BLOCK, by_block


def filter_subjects(df: DataFrame, min_events_per_subject: int | None = None, min_measurements_per_subject: int | None = None) -> DataFrame:
    """Subjects with enough events (distinct times; null time counts as one more) and enough measurements (rows with
    a time). A threshold of null or 0 is off. The input is read once: windows over the subject, which later windows
    by subject and time share, count beside each row."""
    out, (test,) = _counted(df, [{"min_events_per_subject": min_events_per_subject, "min_measurements_per_subject": min_measurements_per_subject}], ["subject_id"])
    return df if test is None else out.where(test).drop("__new", "__events", "__rows")


def filter_subjects_in_blocks(df: DataFrame, blocks: list[dict[str, Any]]) -> DataFrame:
    """Each block's rows by themselves: a subject's events and measurements are counted within the block."""
    out, tests = _counted(df, blocks, ["subject_id", BLOCK])
    return out.where(by_block([F.lit(True) if t is None else t for t in tests], F.lit(True))).drop("__new", "__events", "__rows")


def _counted(df: DataFrame, wanted: list[dict[str, Any]], keys: list[str]) -> tuple[DataFrame, list[Column | None]]:
    """``df`` with the counts that ``wanted`` needs beside each row, and the test of each (None: all rows stay)."""
    names = {"min_events_per_subject": "__events", "min_measurements_per_subject": "__rows"}
    for w in wanted:
        for name in names:
            v = w.get(name)
            if v is not None and (not isinstance(v, int) or isinstance(v, bool)):
                raise TypeError(f"{name} must be an integer; got {type(v).__name__} {v}")
    subject, out, counts = Window.partitionBy(*keys), df, {}
    if any(w.get("min_events_per_subject") for w in wanted):
        before = F.lag("time").over(subject.orderBy("time"))
        new = F.col("time").isNotNull() & ~F.col("time").eqNullSafe(before)
        out = out.withColumn("__new", new.cast("int"))
        counts["__events"] = F.sum("__new").over(subject) + F.max(F.col("time").isNull().cast("int")).over(subject)
    if any(w.get("min_measurements_per_subject") for w in wanted):
        counts["__rows"] = F.count("time").over(subject)
    tests = []
    for w in wanted:
        least = [F.col(c) >= w[name] for name, c in names.items() if w.get(name)]
        # A null subject is none.
        tests.append(reduce(and_, [*least, F.col("subject_id").isNotNull()]) if least else None)
    return (out.withColumns(counts) if counts else out), tests


def filter_measurements(df: DataFrame, code_metadata: DataFrame, min_subjects_per_code: int | None = None, min_occurrences_per_code: int | None = None, code_modifiers: list[str] | None = None) -> DataFrame:
    """Rows whose code has enough subjects and occurrences in the metadata; null keys never match."""
    tests = {"code/n_subjects": min_subjects_per_code, "code/n_occurrences": min_occurrences_per_code}
    tests = {k: v for k, v in tests.items() if v is not None}
    if not tests:
        return df
    keep = code_metadata
    for k, v in tests.items():
        keep = keep.where(F.col(f"`{k}`") >= v)
    keys = ["code", *(code_modifiers or [])]
    return df.join(keep.select(*keys), keys, "left_semi")


def filter_measurements_in_blocks(df: DataFrame, blocks: list[dict[str, Any]], code_metadata: DataFrame, code_modifiers: list[str] | None = None) -> DataFrame:
    """Each block with its own thresholds; the metadata is joined once."""
    keys = ["code", *(code_modifiers or [])]
    names = {"min_subjects_per_code": "code/n_subjects", "min_occurrences_per_code": "code/n_occurrences"}
    enough = [[F.col(f"`{c}`") >= b[n] for n, c in names.items() if b.get(n) is not None] for b in blocks]
    flags = [F.max(reduce(and_, t)).alias(f"__enough{i}") for i, t in enumerate(enough) if t]
    if not flags:
        return df
    meta = code_metadata.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*flags)
    on = reduce(and_, [F.col(f"`{k}`") == F.col(f"__k{i}") for i, k in enumerate(keys)])
    kept = by_block([F.col(f"__enough{i}") if t else F.lit(True) for i, t in enumerate(enough)], F.lit(True))
    return df.join(meta, on, "left").where(kept).drop(*[c for c in meta.columns])


def drop_regex_in_blocks(df: DataFrame, blocks: list[dict[str, Any]]) -> DataFrame:
    """Each block with its own regex."""
    return df.where(by_block([~F.col("code").rlike(b["regex"]) if b.get("regex") else F.lit(True) for b in blocks], F.lit(True)))


def drop_regex(df: DataFrame, regex: str | None = None) -> DataFrame:
    """Without rows whose code matches (null codes go too); no regex changes nothing."""
    return df.where(~F.col("code").rlike(regex)) if regex else df
