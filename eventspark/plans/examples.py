"""Scenarios of a stage as files: inputs, settings and expected results, which a test runs through a real pipeline.

A scenario is a folder with ``out_data.yaml`` or ``out_metadata.yaml`` (what is expected), and maybe ``in.yaml`` (else the
caller's own input), ``cfg.yaml`` (the stage's settings) and ``error.txt`` (a pattern that the error's message must hold,
in place of results). A stage's ``examples`` folder is one, or holds some, at any depth.

A table file maps paths (``data/train/0.parquet``, ``metadata/codes.parquet``) to CSV text or to a list of rows.
"""

from __future__ import annotations

import csv
import io
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.plans.pipeline import Pipeline, Step
from eventspark.plans.registry import Registry, Stage
from eventspark.sources import tables

#: Types of the columns that every table has in common; others are found from their values.
KINDS = {"subject_id": "bigint", "time": "timestamp", "code": "string", "numeric_value": "float", "text_value": "string", "categorical_value": "string", "description": "string", "parent_codes": "array<string>", "split": "string"}
_TIMES = ("%m/%d/%Y, %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d")
_EXPECTED = ("out_data.yaml", "out_metadata.yaml", "error.txt")


@dataclass
class Scenario:
    name: str
    settings: dict[str, Any] = field(default_factory=dict)
    inputs: dict[str, Any] | None = None
    data: dict[str, Any] | None = None
    metadata: dict[str, Any] | None = None
    error: str | None = None


def scenarios(folder: str | Path) -> list[Scenario]:
    """Those of a stage's ``examples`` folder, by name; none if it isn't there."""
    root, out = Path(folder), []
    for at in sorted({f.parent for n in _EXPECTED for f in root.rglob(n)}):
        given = {n: yaml.safe_load((at / f"{n}.yaml").read_text()) for n in ("cfg", "in", "out_data", "out_metadata") if (at / f"{n}.yaml").is_file()}
        error = (at / "error.txt").read_text().strip() if (at / "error.txt").is_file() else None
        out.append(Scenario(at.relative_to(root).as_posix(), given.get("cfg") or {}, given.get("in"), given.get("out_data"), given.get("out_metadata"), error))
    return out


def of_stage(stage: Stage) -> list[Scenario]:
    return scenarios(stage.folder / "examples") if stage.folder else []


def _value(x: Any, kind: str) -> Any:
    if x is None or x == "":
        return None
    if kind == "timestamp" and isinstance(x, str):
        return next(t for t in (_time(x, f) for f in _TIMES) if t is not None)
    plain = {"bigint": int, "float": float, "double": float, "string": str, "boolean": lambda v: v if isinstance(v, bool) else str(v).lower() == "true"}
    return plain[kind](x) if kind in plain else x


def _time(text: str, form: str) -> datetime | None:
    try:
        return datetime.strptime(text, form)
    except ValueError:
        return None


def _kind(values: list[Any]) -> str:
    """The narrowest type that all values (numbers, or their text) have."""
    known = [v for v in values if v not in (None, "")]
    if known and all(isinstance(v, list) for v in known):
        return "array<string>"
    for kind, form in (("boolean", r"(?i)true|false"), ("bigint", r"[+-]?\d+"), ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|[+-]?inf(inity)?)")):
        if known and all(re.fullmatch(form, str(v)) for v in known):
            return kind
    return "string"


def table(spark: SparkSession, given: str | list[dict[str, Any]]) -> DataFrame:
    """A table from CSV text or rows; empty cells are null."""
    rows = list(csv.DictReader(io.StringIO(given), skipinitialspace=True)) if isinstance(given, str) else list(given)
    header = list(csv.reader(io.StringIO(given)))[0] if isinstance(given, str) else []
    names = [n.strip() for n in header] or list(dict.fromkeys(k for r in rows for k in r))
    kinds = {n: KINDS.get(n) or _kind([r.get(n) for r in rows]) for n in names}
    return spark.createDataFrame([tuple(_value(r.get(n), kinds[n]) for n in names) for r in rows], ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def write_inputs(spark: SparkSession, given: dict[str, Any], root: str) -> None:
    for path, rows in given.items():
        table(spark, rows).coalesce(1).write.mode("overwrite").parquet(f"{root}/{path}")


def _alike(a: Any, b: Any) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-3, abs_tol=1e-5) or (math.isnan(a) and math.isnan(b))
    return list(a) == list(b) if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)) else a == b


def differences(got: list[dict[str, Any]], want: list[dict[str, Any]]) -> list[str]:
    """Where two lists of rows differ, row by row and column by column; columns that are not expected count too."""
    out = [] if len(got) == len(want) else [f"{len(got)} rows instead of {len(want)}"]
    for i, (g, w) in enumerate(zip(got, want, strict=False)):
        out += [f"row {i}, {c}: {g.get(c)!r} instead of {w.get(c)!r}" for c in dict.fromkeys([*w, *g]) if (c in g) != (c in w) or not _alike(g.get(c), w.get(c))]
    return out


def check(spark: SparkSession, stage: str, scenario: Scenario, registry: Registry, folder: str | Path, given: Callable[[str], None] | None = None) -> None:
    """Run a scenario below ``folder`` and raise an ``AssertionError`` that names what differs.

    Data is compared subject by subject in row order, metadata by code; numbers to a thousandth. ``given`` writes the
    input (into the folder that it gets) of a scenario that has none of its own.
    """
    source, target = f"{folder}/in", f"{folder}/out"
    if scenario.inputs is not None:
        write_inputs(spark, scenario.inputs, source)
    elif given is not None:
        given(source)
    else:
        raise ValueError(f"Scenario '{scenario.name}' of '{stage}' has no input")
    pipeline = Pipeline([Step(stage, stage, dict(scenario.settings))], registry)
    if scenario.error is not None:
        try:
            pipeline.run(spark, source, target, overwrite=True)
        except Exception as e:
            assert re.search(scenario.error, str(e)), f"{scenario.name}: the error says {str(e)[:300]!r}, not '{scenario.error}'"
            return
        raise AssertionError(f"{scenario.name}: no error, though one with '{scenario.error}' is expected")
    pipeline.run(spark, source, target, overwrite=True)
    if scenario.data is not None:
        got = spark.read.parquet(f"{target}/data").drop("split", "shard")
        rows = [r.asDict() for x in scenario.data.values() for r in table(spark, x).collect()]
        where = sorted({r["subject_id"] for r in rows})
        own = [r.asDict() for r in got.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__at")).orderBy("subject_id", "__at").drop("__at").collect()]
        want = [r for i in where for r in rows if r["subject_id"] == i]
        assert not (off := differences(own, want)), f"{scenario.name}, data: {off[:10]}"
    if scenario.metadata is not None:
        (rows,) = scenario.metadata.values()
        own, want = ([r.asDict(recursive=True) for r in tables.sorted_codes(d).collect()] for d in (spark.read.parquet(f"{target}/metadata/codes"), table(spark, rows)))
        assert not (off := differences(own, want)), f"{scenario.name}, metadata: {off[:10]}"
