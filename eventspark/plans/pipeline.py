"""A pipeline of configured stages as one lazy plan."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from eventspark.operators.codes import merge_metadata
from eventspark.operators.incremental import CodeStatistics
from eventspark.operators.match_revise import match_revise
from eventspark.plans.registry import Registry, Stage, builtin, installed
from eventspark.sources import tables


@dataclass
class Step:
    name: str
    base: str
    settings: dict[str, Any] = field(default_factory=dict)


def parse_stages(items: list[Any]) -> list[Step]:
    """Steps from names and ``{name: settings}``; ``_base_stage`` names the stage behind an alias."""
    if not isinstance(items, list):
        raise TypeError(f"stages must be a list, not {type(items).__name__}")
    out: list[Step] = []
    for x in items:
        if isinstance(x, str):
            name, settings = x, {}
        elif isinstance(x, dict) and len(x) == 1:
            name, settings = next(iter(x.items()))
            settings = dict(settings or {})
        else:
            raise ValueError(f"A stage is a name or a dictionary with one name: {x!r}")
        out.append(Step(name, settings.pop("_base_stage", name), settings))
    names = [s.name for s in out]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"Stage names must be unique: {twice}")
    return out


def set_override(cfg: dict[str, Any], text: str) -> None:
    """``a.b=value`` with a YAML value; below ``stages`` the next part names a stage."""
    key, _, value = text.partition("=")
    if not _:
        raise ValueError(f"Not key=value: {text}")
    at: Any = cfg
    *parts, last = key.split(".")
    for p in parts:
        if isinstance(at, list):
            i = next((i for i, x in enumerate(at) if x == p or (isinstance(x, dict) and p in x)), None)
            if i is None:
                raise ValueError(f"No stage '{p}' to override")
            if isinstance(at[i], str) or at[i][p] is None:
                at[i] = {p: {}}
            at = at[i][p]
        else:
            at = at.setdefault(p, {})
    at[last] = yaml.safe_load(value)


def load_config(path: str | Path, overrides: list[str] | None = None) -> dict[str, Any]:
    if str(path) == "__null__":
        cfg: Any = {}
    elif str(path).startswith("pkg://"):
        from importlib.resources import files

        package, _, rest = str(path)[6:].partition(".")
        stem, _, suffix = rest.rpartition(".")
        cfg = yaml.safe_load(files(package).joinpath(stem.replace(".", "/") + "." + suffix).read_text()) or {}
    else:
        cfg = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(cfg, dict):
        raise ValueError("A pipeline configuration must be a mapping")
    for o in overrides or []:
        set_override(cfg, o)
    return cfg


def with_file_bins(settings: dict[str, Any]) -> dict[str, Any]:
    """Bins of a YAML file under ``custom_bins_filepath``, with those given in place over them."""
    settings = dict(settings)
    path = settings.pop("custom_bins_filepath", None)
    if path is not None:
        bins = yaml.safe_load(Path(path).read_text())
        if not isinstance(bins, dict):
            raise TypeError("custom_bins_filepath must point to a YAML file with a dictionary")
        settings["custom_bins"] = {**bins, **(settings.get("custom_bins") or {})}
    return settings


@dataclass(frozen=True)
class Rows:
    """What flows between steps: all rows, the code metadata, the split of each subject, and rows from train shards."""

    df: DataFrame | None
    meta: DataFrame | None = None
    splits: DataFrame | None = None
    train: DataFrame | None = None

    def of_train(self) -> DataFrame:
        if self.train is not None:
            return self.train
        if self.splits is None:
            raise FileNotFoundError("A fit on train subjects needs train shards or metadata/subject_splits.parquet; set train_only: false to learn from all rows")
        return tables.of_split(self.df, self.splits)


def _mark(what: Any) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass
class Pipeline:
    """Composes stages. Rows flow through ``map`` stages. ``fit`` stages see the train split only and merge into the
    code metadata, which later stages get. Nothing runs until a result is used: one plan, in which Spark reuses equal
    shuffles.

    Train rows are those of ``train``, rows that come from train shards alone and go through the same stages, or those
    of the train subjects of ``splits``. A fit without either is refused, unless the stage says ``train_only: false``.
    """

    steps: list[Step]
    registry: Registry = field(default_factory=builtin)
    code_modifiers: list[str] | None = None
    float32: bool = False

    @classmethod
    def from_config(cls, cfg: dict[str, Any], registry: Registry | None = None) -> Pipeline:
        registry = installed() if registry is None else registry
        p = cls(parse_stages(cfg.get("stages", [])), registry, cfg.get("code_modifiers"), bool(cfg.get("float32_stats", False)))
        if unknown := [s.base for s in p.steps if s.base not in registry]:
            raise KeyError(f"Unknown stages: {unknown}. Known: {sorted(registry)}")
        return p

    def apply_step(self, step: Step, rows: Rows) -> Rows:
        stage = self.registry[step.base]
        settings = dict(step.settings)
        train_only = settings.pop("train_only", stage.kind == "fit")
        if train_only and stage.kind != "fit":
            raise ValueError(f"'{step.name}' is a {stage.kind} stage, which has all rows; only a fit is train_only")
        if step.base == "bin_numeric_values":
            settings = with_file_bins(settings)
        blocks, mode = settings.pop("_match_revise", None), settings.pop("_match_revise_mode", "match_and_revise")
        if blocks is not None and stage.kind != "map":
            raise ValueError(f"Match and revise works on map stages only; '{step.base}' is a {stage.kind} stage")

        def over(df: DataFrame | None) -> DataFrame:
            if blocks is not None:
                together = (lambda d, each: stage.bind_blocks([with_file_bins(s) for s in each], self._given(d, rows))) if stage.together else None
                return match_revise(df, blocks, lambda d, s: self._call(stage, with_file_bins(s), d, rows), settings, mode, stage.columns, together)
            return self._call(stage, settings, df, rows)

        if stage.kind == "fit":
            got = over(rows.of_train() if train_only else rows.df)
            return replace(rows, meta=merge_metadata(got, rows.meta, self.code_modifiers) if rows.meta is not None else got)
        if stage.kind == "meta":
            return replace(rows, meta=over(rows.df))
        if stage.kind == "main":  # it decides on rows and shards itself
            return replace(rows, df=over(rows.df), train=None)
        return replace(rows, df=over(rows.df), train=None if rows.train is None else over(rows.train))

    def _call(self, stage: Stage, settings: dict[str, Any], df: DataFrame | None, rows: Rows) -> DataFrame:
        return stage.bind(settings, self._given(df, rows))

    def _given(self, df: DataFrame | None, rows: Rows) -> dict[str, Any]:
        """What a plan has to give to a stage."""
        spark = df.sparkSession if df is not None else SparkSession.active()
        return {"df": df, "code_metadata": rows.meta, "splits": rows.splits, "code_modifiers": self.code_modifiers, "float32": self.float32, "spark": spark}

    def apply(self, df: DataFrame | None, meta: DataFrame | None = None, splits: DataFrame | None = None, train: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(rows, code metadata) after all steps."""
        rows = Rows(df, meta, splits, train)
        for step in self.steps:
            rows = self.apply_step(step, rows)
        return rows.df, rows.meta

    def run(self, spark: SparkSession, input_dir: str, output_dir: str, overwrite: bool = False, keep_intermediates: bool = False, read: Callable[[SparkSession, str], DataFrame] | None = None, write: Callable[[DataFrame, str], None] | None = None) -> None:
        """Read ``data``, ``metadata/codes.parquet`` and ``metadata/subject_splits.parquet``, write ``data`` and
        ``metadata/codes``. If ``data`` has a ``train`` folder, fits read only its shards. A first stage that takes no
        rows is the source itself.

        Each fit is written once and read again, so its scan isn't repeated by every later use; so are the rows before
        every fit but the first that sees changed rows, so that the input is read as often whatever the number of fits.
        A finished part is
        taken up by a rerun if it was made from the same files by the same stages and settings; else it is made anew.
        With ``incremental: true`` an ``aggregate_code_metadata`` before any change of rows keeps partial results by input
        file in ``output_dir``, and a later run reads only files that are new or have changed for it.
        ``read`` and ``write`` replace the Parquet source and sink of the rows; a stage may have its own
        (``Registry.add(read=..., write=...)``): the former replaces the rows it gets, the latter is given its result.
        """
        root = output_dir.rstrip("/")
        first = self.registry[self.steps[0].base] if self.steps else None
        sourced = first is not None and (first.takes_no_rows or first.read is not None)
        seen = [self.code_modifiers, self.float32, [] if sourced or read else tables.file_marks(spark, f"{input_dir}/data")]
        marks = [_mark([*seen, [[s.name, s.base, s.settings] for s in self.steps[: i + 1]]]) for i in range(len(self.steps))] or [_mark(seen)]
        if tables.is_complete(spark, f"{root}/data", marks[-1]) and not overwrite:
            return
        df = train = None
        if read:
            df = read(spark, f"{input_dir}/data")
        elif not sourced:
            df = tables.read_events(spark, f"{input_dir}/data", keep_order=True)
            if tables.has_shards(spark, f"{input_dir}/data/train"):
                train = tables.read_events(spark, f"{input_dir}/data", "train", keep_order=True)
        written, fits = df, 0
        rows = Rows(df, self._optional(spark, f"{input_dir}/metadata/codes.parquet"), self._optional(spark, f"{input_dir}/metadata/subject_splits.parquet"), train)
        for i, step in enumerate(self.steps):
            stage = self.registry[step.base]
            at, before = f"{root}/stages/{i:02d}-{step.name}", rows
            if stage.read is not None:
                rows = replace(rows, df=stage.read(spark, input_dir), train=None)
            elif stage.kind == "fit" and rows.df is not written:
                fits += 1
                if fits > 1:  # else each fit would compute all stages before it from the input again
                    parts = {n: None if x is None else tables.once(x, f"{at}-{n}", marks[i - 1], overwrite) for n, x in (("rows", rows.df), ("train", rows.train))}
                    rows = before = replace(rows, df=parts["rows"], train=parts["train"])
                written = rows.df
            if step.settings.get("incremental"):
                if before.df is not df:
                    raise ValueError(f"'{step.name}' is incremental, so no stage may change the rows before it")
                rows = replace(rows, meta=self._kept_up(spark, step, input_dir, f"{root}/statistics/{step.name}", rows))
            else:
                rows = self.apply_step(replace(step, settings={k: v for k, v in step.settings.items() if k != "incremental"}), rows)
            if stage.is_metadata and rows.meta is not before.meta:
                rows = replace(rows, meta=tables.once(rows.meta, at, marks[i], overwrite))
            elif keep_intermediates and not stage.is_metadata:
                rows = replace(rows, df=tables.once(rows.df, at, marks[i], overwrite))
            if stage.write is not None:
                stage.write(rows.df, at)
        if first is not None and first.codes is not None and rows.meta is None:
            rows = replace(rows, meta=first.codes(rows.df))
        mode = "overwrite"
        if rows.meta is not None:
            tables.sorted_codes(rows.meta).write.mode(mode).parquet(f"{root}/metadata/codes")
        if write:
            write(rows.df, f"{root}/data")
            return
        tables.write_events(rows.df, f"{root}/data", mode=mode)
        tables.sign(spark, f"{root}/data", marks[-1])

    def _kept_up(self, spark: SparkSession, step: Step, input_dir: str, path: str, rows: Rows) -> DataFrame:
        """Code statistics from partial results by file below ``path``; only files that are new or changed are read."""
        settings = {k: v for k, v in step.settings.items() if k != "incremental"}
        train_only, data, keep, mark = settings.pop("train_only", True), f"{input_dir}/data", None, ""
        if step.base != "aggregate_code_metadata" or settings.keys() - {"aggregations", "do_summarize_over_all_codes"}:
            raise ValueError(f"'{step.name}' can't be incremental: only aggregate_code_metadata can, without match and revise")
        if train_only and rows.train is not None:
            data = f"{data}/train"
        elif train_only:
            rows.of_train()  # refuses a fit without splits
            keep, mark = (lambda df: tables.of_split(df, rows.splits)), _mark(tables.file_marks(spark, f"{input_dir}/metadata/subject_splits.parquet"))
        kept = CodeStatistics(spark, path, self.code_modifiers)
        kept.refresh(data, keep, mark)
        got = kept.metadata(settings["aggregations"], settings.get("do_summarize_over_all_codes", False), self.float32)
        return merge_metadata(got, rows.meta, self.code_modifiers) if rows.meta is not None else got

    @staticmethod
    def _optional(spark: SparkSession, path: str) -> DataFrame | None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
