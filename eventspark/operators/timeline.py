"""Time-derived measurements: age, time of day and timeline tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from eventspark.functions.blocks import BLOCK, by_block
from eventspark.functions.units import time_unit
from eventspark.sources.tables import ORDER

#: What is derived where a stage doesn't say otherwise.
DEFAULTS: dict[str, Any] = {
    "age": {"DOB_code": None, "DOB_regex": "^MEDS_BIRTH(//.*)?", "age_code": "AGE", "age_unit": "years"},
    "time_of_day": {"time_of_day_code": "TIME_OF_DAY", "endpoints": [6, 12, 18, 24]},
}


def _subject(*more: str) -> WindowSpec:
    return Window.partitionBy("subject_id", *more)


@dataclass
class Part:
    """A row made of an event: when, its code and its value. ``rank`` orders the rows of one event; ``last`` rows
    come after the event's own."""

    when: Column
    code: Column
    value: Column | None = None
    rank: int = 0
    last: bool = False


def unique_events(df: DataFrame) -> DataFrame:
    """Distinct (subject, time) with a time; with a carried order, that of the first row of each."""
    timed = df.where(F.col("time").isNotNull())
    if ORDER in df.columns:
        return timed.groupBy("subject_id", "time").agg(F.min(ORDER).alias(ORDER))
    return timed.select("subject_id", "time").distinct()


def _between(a: str, b: str, seconds: float) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6 * seconds)


def _micros(a: str, b: str, seconds: float) -> Column:
    return _between(a, b, seconds).cast("float")


def birth_rows(cfg: dict[str, Any]) -> Column:
    """Whether a row is a birth."""
    part, pattern = cfg.get("DOB_code"), cfg.get("DOB_regex")
    if part is None and pattern is None:
        raise ValueError("An age needs 'DOB_code' or 'DOB_regex' to find births by")
    return F.col("code").rlike(pattern) if part is None else F.col("code").contains(part)


def births_of(df: DataFrame, born: Column, *more: str) -> DataFrame:
    """(subject_id, ``more``, __dob, __nth) of each birth row, numbered within the subject."""
    nth = F.row_number().over(_subject(*more).orderBy(F.col(ORDER if ORDER in df.columns else "time")))
    return df.where(born).select("subject_id", *more, F.col("time").alias("__dob"), nth.alias("__nth"))


def age_parts(cfg: dict[str, Any]) -> list[Part]:
    value = _micros("time", "__dob", time_unit(cfg.get("age_unit", "y"))[1])
    return [Part(value > 0, F.lit(cfg.get("age_code", "AGE")), value)]


def _hours(ends: Any) -> list[int]:
    """Endpoints that are whole hours of a day, each later than the one before."""
    ends = list(ends or ())
    wrong = [e for e in ends if type(e) is not int]
    if wrong:
        raise ValueError(f"Endpoints of times of day are hours as integers, which {wrong} are not")
    if not ends:
        raise ValueError("Times of day need at least one endpoint")
    if min(ends) < 0 or max(ends) > 24:
        raise ValueError(f"Hours lie between 0 and 24, unlike those of {ends}")
    if any(a >= b for a, b in zip(ends, ends[1:], strict=False)):
        why = "sorted" if len(set(ends)) == len(ends) else "unique"
        raise ValueError(f"Endpoints have to be {why}: {ends}")
    return ends


def hours_of(ends: Any) -> list[tuple[int, int]]:
    """The parts of a day: from which hour to which."""
    ends = _hours(ends)
    return [*zip([0, *ends], ends, strict=False), (ends[-1], 24)]


def time_of_day_parts(cfg: dict[str, Any]) -> list[Part]:
    name, code = cfg["time_of_day_code"], F.lit(None).cast("string")
    for lo, hi in reversed(hours_of(cfg.get("endpoints"))):
        code = F.when((F.hour("time") >= lo) & (F.hour("time") < hi), F.lit(f"{name}//[{lo:02},{hi:02})")).otherwise(code)
    return [Part(F.lit(True), code)]


def timeline_parts(cfg: dict[str, Any]) -> list[Part]:
    start, end = cfg.get("timeline_start_code", "TIMELINE//START"), cfg.get("timeline_end_code", "TIMELINE//END")
    delta, out = cfg.get("time_delta_code", "TIMELINE//DELTA//{time_unit}"), []
    none = F.lit(None).cast("float")
    if start is not None:
        out.append(Part(F.col("__prev").isNull(), F.lit(start), none, 0))
    if delta is not None:
        unit, seconds = time_unit(cfg["time_unit"])
        out.append(Part(F.col("__prev").isNotNull(), F.lit(delta.format(time_unit=unit)), _micros("time", "__prev", seconds), 1))
    if end is not None:
        out.append(Part(F.col("time") == F.col("__end"), F.lit(end), none, 2, last=True))
    # A start or delta whose code is the end's is placed as the end is.
    return [Part(p.when, p.code, p.value, p.rank, c == end) for p, c in zip(out, [x for x in (start, delta, end) if x is not None], strict=True)]


def _neighbours(events: DataFrame) -> DataFrame:
    return events.withColumns({"__prev": F.lag("time").over(_subject().orderBy("time")), "__end": F.max("time").over(_subject())})


def signed_ages(events: DataFrame, births: DataFrame, *cfgs: dict[str, Any]) -> DataFrame:
    """Age at each of the distinct ``events``, below 0 before birth, as a double; one row for each of the subject's
    ``births`` (``births_of``) and each of ``cfgs``."""
    each = [F.struct(F.lit(c.get("age_code", "AGE")).alias("code"), _between("time", "__dob", time_unit(c.get("age_unit", "y"))[1]).alias("numeric_value")) for c in cfgs]
    return events.join(births, "subject_id").select(*events.columns, F.inline(F.array(*each)))


def age(df: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """Age at each event after birth, in single precision; one row for each birth row of the subject."""
    out = signed_ages(unique_events(df), births_of(df, birth_rows(cfg)), cfg)
    return out.withColumn("numeric_value", F.col("numeric_value").cast("float")).where(F.col("numeric_value") > 0)


def time_of_day(df: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """The part of the day of each event."""
    (part,) = time_of_day_parts(cfg)
    return unique_events(df).withColumn("code", part.code)


def timeline_tokens(df: DataFrame, cfg: dict[str, Any]) -> DataFrame | None:
    """Start and end of each subject's timeline and the time between events; None if all three are off."""
    parts = timeline_parts(cfg)
    if not parts:
        return None
    made = F.array_compact(F.array(*[F.when(p.when, F.struct(F.lit(p.rank).alias("k"), p.code.alias("code"), p.value.alias("numeric_value"))) for p in parts]))
    rows = _neighbours(unique_events(df)).withColumn("__x", F.explode(made))
    keep = ["subject_id", "time", F.col("__x.code").alias("code"), F.col("__x.numeric_value").alias("numeric_value")]
    if ORDER in df.columns:
        keep.append(F.struct(F.col("__x.k").alias("k"), F.col(ORDER).alias("o")).alias(ORDER))
    return rows.select(*keep)


def add_new_events(df: DataFrame, new: DataFrame, new_code_last_regex: str | None = None) -> DataFrame:
    """New rows go before the rows of the same time, those whose code matches the regex after them. Columns that
    one side lacks are null. A carried order becomes a pair: the place beside the old rows, and the order before."""
    if ORDER not in df.columns:
        return df.unionByName(new, allowMissingColumns=True)
    last = F.col("code").rlike(new_code_last_regex) if new_code_last_regex is not None else F.lit(False)
    w = _subject().orderBy(F.col("time").asc_nulls_first(), ORDER)
    place = lambda d, b: d.withColumn(ORDER, F.struct(b.alias("b"), F.row_number().over(w).cast("long").alias("o")))
    return place(df, F.lit(0)).unionByName(place(new, F.when(last, 1).otherwise(-1)), allowMissingColumns=True)


_PARTS: dict[str, Callable[[dict[str, Any]], list[Part]]] = {"age": age_parts, "time_of_day": time_of_day_parts, "timeline_tokens": timeline_parts}


def add_time_derived_measurements(df: DataFrame, features: dict[str, Any]) -> DataFrame:
    """Applies the features in the order given; the rows of each go before those of the features before it and
    the event's own, a timeline end after them. A null feature is off.

    One window by subject and time marks the first row of each event and knows the event before; all features' rows
    are one array, exploded beside that row. So the input is read once, and once more for births if ages are asked
    for. Births are those of the input, not rows that another feature makes."""
    return _derived(df, [features])


def add_time_derived_measurements_in_blocks(df: DataFrame, blocks: list[dict[str, Any]]) -> DataFrame:
    """Each block's rows by themselves, with the block's own features, in one plan: the windows go by subject and
    block."""
    return _derived(df, blocks, BLOCK)


def _derived(df: DataFrame, blocks: list[dict[str, Any]], *more: str) -> DataFrame:
    """Windows and births by subject and ``more``, which is the block's column or nothing (then all rows are of the only
    block)."""
    if unknown := [x for features in blocks for x in features if x not in _PARTS]:
        raise ValueError(f"Unknown time-derived measurement: {', '.join(unknown)}")
    parts = [(n, i, name, p) for n, features in enumerate(blocks) for i, (name, cfg) in enumerate(features.items()) if cfg is not None for p in _PARTS[name](cfg)]
    if not parts:
        return df
    carried, births = ORDER in df.columns, None
    if any(features.get("age") is not None for features in blocks):
        born = [birth_rows(features["age"]) if features.get("age") is not None else F.lit(False) for features in blocks]
        births = births_of(df, by_block(born, F.lit(False)) if more else born[0], *more)
    by_time = _subject(*more).orderBy("time", *[ORDER] * carried)
    rows = df.withColumns({"__prev": F.lag("time").over(by_time), "__end": F.max("time").over(_subject(*more))})
    rows = rows.withColumn("__first", F.col("time").isNotNull() & ~F.col("time").eqNullSafe(F.col("__prev")))
    if births is not None:
        keys = {k: f"__born_{k}" for k in ("subject_id", *more)}
        on = reduce(and_, [F.col(k) == F.col(b) for k, b in keys.items()])
        rows = rows.join(births.withColumnsRenamed(keys), on, "left").drop(*keys.values())
    once = F.coalesce(F.col("__nth") == 1, F.lit(True)) if births is not None else F.lit(True)

    kinds = {f.name: f.dataType for f in df.schema}
    kind = kinds.get("numeric_value", "float")
    has_value = "numeric_value" in kinds or any(p.value is not None for *_, p in parts)

    def made(own: Column, b: int, k: int, code: Column, value: Column) -> Column:
        return F.struct(own.alias("own"), F.lit(b).alias("b"), F.lit(k).alias("k"), code.cast(kinds["code"]).alias("code"), value.cast(kind).alias("value"))

    none = F.lit(None).cast("float")
    every = [F.when(once, made(F.lit(True), 0, 0, F.col("code"), F.col("numeric_value") if "numeric_value" in kinds else none))]
    for n, i, name, p in parts:
        test = F.col("__first") & p.when & (F.lit(True) if name == "age" else once)
        test = (F.col(BLOCK) == n) & test if more else test
        every.append(F.when(test, made(F.lit(False), i + 1 if p.last else -(i + 1), p.rank, p.code, none if p.value is None else p.value)))
    rows = rows.withColumn("__x", F.explode(F.array_compact(F.array(*every))))

    out = {"subject_id": F.col("subject_id"), "time": F.col("time"), "code": F.col("__x.code"), "numeric_value": F.col("__x.value"), **{k: F.col(k) for k in more}}
    names = [*df.columns, *["numeric_value"] * (has_value and "numeric_value" not in kinds)]
    for name in names:
        out.setdefault(name, F.when(F.col("__x.own"), F.col(f"`{name}`")))
    if carried:
        nth = F.coalesce(F.col("__nth"), F.lit(0)) if births is not None else F.lit(0)
        out[ORDER] = F.struct(F.col("__x.b").alias("b"), F.col("__x.k").alias("k"), F.col(ORDER).alias("o"), nth.alias("nth"))
    return rows.select(*[out[name].alias(name) for name in names])
