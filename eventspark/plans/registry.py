"""Stages by name: kinds, parameters, defaults, and plugins through entry points."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame

from eventspark.operators.codes import with_all_columns

GROUP = "eventspark.stages"
#: Parameters that a plan fills in by itself.
BOUND = ("df", "code_metadata", "code_modifiers", "splits", "float32", "spark")


@dataclass
class Stage:
    """``kind``: ``map`` (rows to rows), ``fit`` (rows to code metadata), ``meta`` (code metadata to code metadata),
    ``main`` (anything with rows, run once)."""

    name: str
    fn: Callable[..., DataFrame]
    kind: str
    defaults: dict[str, Any] = field(default_factory=dict)
    whole: str | None = None  # parameter that takes all settings as one mapping
    reduce: Callable[..., DataFrame] | None = None  # of a fit: turns the mapped rows into code metadata
    needs: tuple[str, ...] = ()  # columns of the mapped rows that ``reduce`` reads
    columns: Callable[..., dict] | None = None  # of a map that only changes columns: (df, settings) -> columns
    together: Callable[..., DataFrame] | None = None  # of a map: (df with block numbers, settings of each block, ...)
    read: Callable[..., DataFrame] | None = None  # (spark, input folder) -> the rows it gets
    write: Callable[..., None] | None = None  # (its rows, folder)
    codes: Callable[[DataFrame], DataFrame] | None = None  # of a source: rows -> code metadata

    @property
    def takes_no_rows(self) -> bool:
        return "df" not in inspect.signature(self.fn).parameters

    folder: Path | None = None

    @property
    def is_metadata(self) -> bool:
        return self.kind in ("fit", "meta")

    def bind(self, settings: dict[str, Any], given: dict[str, Any]) -> DataFrame:
        """Call with the settings over the defaults (shallow) and what the plan has to give."""
        if self.reduce is not None:
            return self._reduced({**self.defaults, **settings}, given)
        cfg = self._checked(settings)
        own = {k: v for k, v in given.items() if k in inspect.signature(self.fn).parameters}
        return _applied(self.fn(**own, **({self.whole: cfg} if self.whole else cfg)), given)

    def bind_blocks(self, blocks: list[dict[str, Any]], given: dict[str, Any]) -> DataFrame:
        """Call ``together`` with the settings of all blocks, each over the defaults."""
        own = {k: v for k, v in given.items() if k in inspect.signature(self.together).parameters}
        return self.together(blocks=[self._checked(b) for b in blocks], **own)

    def _checked(self, settings: dict[str, Any]) -> dict[str, Any]:
        """The settings over the defaults, refused if the stage doesn't know them."""
        cfg = {**self.defaults, **settings}
        if self.whole:
            return cfg
        params = inspect.signature(self.fn).parameters
        if "do_drop_numeric_value" in cfg:
            cfg.setdefault("drop_numeric_value", cfg.pop("do_drop_numeric_value"))
        if unknown := [k for k in cfg if k not in params]:
            raise ValueError(f"Stage '{self.name}' has no setting {unknown}. Known: {[k for k in params if k not in BOUND]}")
        return cfg

    def _reduced(self, cfg: dict[str, Any], given: dict[str, Any]) -> DataFrame:
        """Mapped rows, checked for what the reduction reads, then reduced. Each function gets the settings that it
        names."""
        own = lambda fn: {k: v for k, v in {**given, **cfg}.items() if k in inspect.signature(fn).parameters and k != "df"}
        known = {*inspect.signature(self.fn).parameters, *inspect.signature(self.reduce).parameters}
        if unknown := sorted(set(cfg) - known):
            raise ValueError(f"Stage '{self.name}' has no setting {unknown}")
        mapped = with_all_columns(self.fn(given["df"], **own(self.fn)), list(self.needs))
        return self.reduce(mapped, **own(self.reduce))


def _applied(got: Any, given: dict[str, Any]) -> DataFrame:
    """A stage may return its result, or a function of the rows (None: the rows as they are)."""
    if got is None:
        return given["df"]
    return got(given["df"]) if callable(got) and not hasattr(got, "columns") else got


def identity(df: DataFrame) -> DataFrame:
    """The rows as they are."""
    return df


class Registry(dict[str, Stage]):
    def add(self, fn: Callable[..., Any] | None, name: str | None = None, kind: str | None = None, defaults: dict[str, Any] | None = None, whole: str | None = None, is_metadata: bool | None = None, reduce: Callable[..., DataFrame] | None = None, needs: tuple[str, ...] = (), **more: Any) -> Stage:
        """``reduce`` makes a user's own fit: ``fn`` maps rows to partial rows (by code, say), which ``reduce`` turns
        into code metadata. ``more``: ``columns``, ``together``, ``read``, ``write`` or ``codes`` of ``Stage``."""
        fn = fn or identity
        name = name or fn.__name__
        if reduce is not None and kind not in (None, "fit"):
            raise ValueError(f"A stage with a reduction is a fit, not {kind}")
        if kind is None:
            kind = "fit" if reduce is not None else "main" if fn.__name__ == "main" else "map"
        if kind not in ("map", "fit", "meta", "main"):
            raise ValueError(f"Unknown kind of stage: {kind}")
        if kind == "main" and is_metadata:
            kind = "meta"
        if name in self:
            raise ValueError(f"Stage '{name}' is registered twice")
        if kind == "main" and (more.get("read") or more.get("write")):
            raise ValueError(f"'{name}' reads and writes by itself, being a main stage")
        self[name] = Stage(name, fn, kind, defaults or {}, whole, reduce, tuple(needs), **more)
        return self[name]

    def add_folder(self, folder: str | Path, fn: Callable[..., Any], **kw: Any) -> Stage:
        """A stage with a folder of its own, named after it: ``config.yaml`` has its defaults (with ``_kind`` if it is
        no map), ``examples/`` its scenarios (``plans.examples``)."""
        folder = Path(folder)
        cfg = {}
        if (folder / "config.yaml").is_file():
            cfg = yaml.safe_load((folder / "config.yaml").read_text()) or {}
            if not isinstance(cfg, dict):
                raise TypeError(f"{folder / 'config.yaml'} must hold a mapping")
        kind = cfg.pop("_kind", None)
        stage = self.add(fn, **{"name": folder.name, "kind": kind, **kw, "defaults": {**cfg, **(kw.get("defaults") or {})}})
        stage.folder = folder
        return stage

    def register(self, **kw: Any) -> Callable:
        """Decorator form of ``add``."""

        def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.add(fn, **kw)
            return fn

        return wrap

    def discover(self) -> None:
        """Add the stages of installed packages: entry points of ``GROUP`` that load to a Stage or a function."""
        points = list(entry_points(group=GROUP))
        if twice := sorted({p.name for p in points if [q.name for q in points].count(p.name) > 1}):
            raise ValueError(f"Installed packages have several stages of one name: {twice}")
        for ep in points:
            got = ep.load()
            if isinstance(got, Stage):
                if ep.name in self:
                    raise ValueError(f"Stage '{ep.name}' is registered twice")
                self[ep.name] = got
            else:
                self.add(got, name=ep.name)


def installed() -> Registry:
    """The built-in stages and those of installed packages."""
    r = builtin()
    r.discover()
    return r


def builtin() -> Registry:
    from eventspark.operators import codes, filters, shards, timeline, values
    from eventspark.sources import tables

    r = Registry()
    r.add(filters.filter_subjects, together=filters.filter_subjects_in_blocks)
    r.add(filters.filter_measurements, together=filters.filter_measurements_in_blocks)
    r.add(filters.drop_regex, together=filters.drop_regex_in_blocks)
    r.add(timeline.add_time_derived_measurements, defaults=timeline.DEFAULTS, whole="features", together=timeline.add_time_derived_measurements_in_blocks)
    r.add(codes.aggregate_code_metadata, kind="fit")
    r.add(codes.fit_vocabulary_indices, kind="meta", defaults={"ordering_method": "lexicographic"})
    r.add(values.normalization, together=values.normalization_in_blocks)
    r.add(values.occlude_outliers, defaults={"stddev_cutoff": 4.5}, together=values.occlude_outliers_in_blocks)
    r.add(values.bin_numeric_values, defaults={"bin_with_columns": ["values/quantiles"], "code_with_bin_name": "{code}//value_[{left},{right})"}, together=values.bin_numeric_values_in_blocks)
    r.add(values.extract_values, whole="columns", columns=values.extracted)
    r.add(values.reorder_measurements, together=values.reorder_measurements_in_blocks)
    r.add(shards.reshard_to_split, kind="main", defaults={"n_subjects_per_shard": 50_000})
    r.add(tables.wide_csv_to_events, kind="main", codes=tables.codes_of)
    return r
