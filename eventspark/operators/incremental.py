"""Code statistics that are kept by input file, so that new shards alone are read when data grows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.operators import codes, sketches
from eventspark.sources import tables
from eventspark.sources.scratch import delete

_FILES = "path string, bytes long, changed long, batch string, mark string"


@dataclass
class Refresh:
    """What a refresh did: files read, files that are gone or were replaced, files whose partial results still hold."""

    read: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    kept: int = 0


class CodeStatistics:
    """Mergeable partial aggregates of event files below ``path``.

    Each refresh writes one batch for the files that it reads: ``subjects`` (sums, counts and extremes by file, key and
    subject), ``codes`` (the same by file and key, made from ``subjects``) and ``values`` (how often each value stands, by
    file and key); if asked for, ``sketches`` (by file and key) as well or in place of the two large ones. A list of files with sizes and times of change says which batch holds which; it is written last, so a
    refresh that dies leaves the former state. ``metadata`` merges the partial results into what
    ``aggregate_code_metadata`` gives over all rows: counts, extremes and quantiles exactly, sums up to the order in which
    doubles are added. Subjects may have rows in several files.

    Files that are gone or were replaced lose their rows at the next refresh; ``compact`` rewrites what is left. One
    refresh at a time: of two that begin from one state, the second fails.
    """

    KINDS = ("subjects", "codes", "values", "sketches")

    def __init__(self, spark: SparkSession, path: str, code_modifiers: list[str] | None = None, kinds: tuple[str, ...] = KINDS[:3]) -> None:
        """``kinds``: the tables to keep, ``codes`` always among them. ``("codes", "sketches")`` is a small store without
        exact counts of subjects and quantiles."""
        if unknown := set(kinds) - set(self.KINDS):
            raise ValueError(f"Unknown tables of statistics: {sorted(unknown)}")
        self.spark, self.path, self.keys = spark, path.rstrip("/"), ["code", *(code_modifiers or [])]
        self.kinds = [k for k in self.KINDS if k in kinds or k == "codes"]

    # -- state -----------------------------------------------------------------------------------------------

    def _states(self) -> list[int]:
        """Numbers of the complete file lists, ascending."""
        return [int(n) for n in tables.complete_folders(self.spark, f"{self.path}/files")]

    def files(self) -> DataFrame:
        """path, bytes, changed, batch and mark of each file whose partial results are kept."""
        states = self._states()
        if not states:
            return self.spark.createDataFrame([], _FILES)
        return self.spark.read.schema(_FILES).parquet(f"{self.path}/files/{states[-1]:08d}")

    def _commit(self, rows: list[tuple]) -> None:
        states = self._states()
        at = (states[-1] if states else 0) + 1
        self.spark.createDataFrame(rows, _FILES).coalesce(1).write.parquet(f"{self.path}/files/{at:08d}")
        for old in states[:-1]:  # the last one stays for readers that have just begun
            delete(self.spark, f"{self.path}/files/{old:08d}")

    # -- refresh ---------------------------------------------------------------------------------------------

    def refresh(self, data: str, keep: Callable[[DataFrame], DataFrame] | None = None, mark: str = "") -> Refresh:
        """Read the files below ``data`` that are new or have changed since the last refresh, forget those that are gone.

        ``keep`` chooses rows (those of train subjects, say), ``mark`` names what it depends on: with another mark every
        file is read again. Keys and the mark belong to the state, so stores are not mixed up.
        """
        mark = f"{','.join(self.keys)}|{','.join(self.kinds)}|{mark}"
        known = {r["path"]: r for r in self.files().collect()}
        now = tables.file_keys(self.spark, data)
        live = {p for p, (_, *s) in now.items() if p in known and [known[p]["bytes"], known[p]["changed"], known[p]["mark"]] == [*s, mark]}
        fresh, gone = sorted(set(now) - live), sorted(set(known) - live)
        if fresh or gone:
            batch = uuid.uuid4().hex
            if fresh:
                self._write([now[p][0] for p in fresh], batch, keep)
            rows = [tuple(known[p]) for p in sorted(live)] + [(p, *now[p][1:], batch, mark) for p in fresh]
            self._commit(rows)
        return Refresh(fresh, gone, len(live))

    def _write(self, files: list[str], batch: str, keep: Callable[[DataFrame], DataFrame] | None) -> None:
        rows = tables.utc(self.spark.read.parquet(*files).withColumn("__file", F.col("_metadata.file_path")))
        rows = rows if keep is None else keep(rows)
        if "numeric_value" not in rows.columns:
            rows = rows.withColumn("numeric_value", F.lit(None).cast("float"))
        by = ["__file", *self.keys]
        every, keyed = list(codes.MERGES), lambda parts: parts.withColumn("__file", tables.file_key(F.col("__file")))
        out = f"{self.path}/batches/{batch}"
        if "subjects" in self.kinds:
            keyed(codes.partial_states(rows, [*by, "subject_id"], every)).write.parquet(f"{out}/subjects")
            codes.merged_states(self.spark.read.parquet(f"{out}/subjects"), by, every).write.parquet(f"{out}/codes")
        else:
            keyed(codes.partial_states(rows, by, every)).write.parquet(f"{out}/codes")
        if "values" in self.kinds:
            keyed(codes.value_counts(rows, by)).write.parquet(f"{out}/values")
        if "sketches" in self.kinds:
            keyed(sketches.sketch_states(rows, by)).write.parquet(f"{out}/sketches")

    # -- results ---------------------------------------------------------------------------------------------

    def _live(self, kind: str) -> DataFrame | None:
        """Partial results of one kind of all files that count; None without any file. Rows of files that a later batch replaced are left out
        by an anti-join with the few that are stale; without any there is no join."""
        files = self.files()
        if kind not in self.kinds:
            raise ValueError(f"These statistics keep {self.kinds}, not '{kind}'")
        batches = sorted(r["batch"] for r in files.select("batch").distinct().collect())
        if not batches:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/batches/{b}/{kind}").withColumn("__batch", F.lit(b)) for b in batches]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        held = files.select(F.col("path").alias("__file"), F.col("batch").alias("__batch"))
        if self._stale(batches, held):
            rows = rows.join(held, ["__file", "__batch"], "left_semi")
        return rows

    def _stale(self, batches: list[str], held: DataFrame) -> bool:
        made = [self.spark.read.parquet(f"{self.path}/batches/{b}/codes").select("__file", F.lit(b).alias("__batch")).distinct() for b in batches]
        there = made[0]
        for m in made[1:]:
            there = there.unionByName(m)
        return not there.join(held, ["__file", "__batch"], "left_anti").isEmpty()

    def metadata(self, aggregations: list, do_summarize_over_all_codes: bool = False, float32: bool = False) -> DataFrame:
        """As ``aggregate_code_metadata`` over all rows of the files. Only tables that an aggregate needs are read."""
        specs = codes.parse_aggregations(aggregations)
        names = [n for n, _ in specs if n in codes.AGGREGATES] or ["code/n_occurrences"]
        if unknown := [n for n in names if n not in codes.MERGES and n not in codes.SUBJECTS]:
            raise ValueError(f"Partial results of {unknown} can't be merged")
        kind = "subjects" if any(n in codes.SUBJECTS for n in names) else "codes"
        parts = self._live(kind)
        if parts is None:
            raise FileNotFoundError(f"No statistics below {self.path}; refresh them first")

        def merged(keys: list[str]) -> DataFrame:
            rows = codes.merged_states(parts, [*keys, "subject_id"], list(codes.MERGES)) if kind == "subjects" else parts
            out = codes.merged_states(rows, keys, names)
            counts = lambda: self._live("values").groupBy(*keys, "__v").agg(F.sum("__c").alias("__c"))
            return codes.with_others(out, keys, specs, counts, lambda: sketches.merged_sketches(self._live("sketches"), keys))

        return codes.summarized(merged, self.keys, parts.schema, do_summarize_over_all_codes, float32)

    # -- upkeep ----------------------------------------------------------------------------------------------

    def compact(self) -> None:
        """Write the partial results that count into one batch, for stores of very many or of stale batches, and delete
        those that no file list names."""
        rows = [r.asDict() for r in self.files().collect()]
        if not rows:
            return
        batch = uuid.uuid4().hex
        for kind in self.kinds:
            self._live(kind).drop("__batch").write.parquet(f"{self.path}/batches/{batch}/{kind}")
        self._commit([(r["path"], r["bytes"], r["changed"], batch, r["mark"]) for r in rows])
        for old in tables.folders(self.spark, f"{self.path}/batches"):
            if old != batch:
                delete(self.spark, f"{self.path}/batches/{old}")
