"""Operators on codes and values: normalization, outliers, bins, extraction, order of codes."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventspark.functions import dsl
from eventspark.functions.blocks import BLOCK, by_block
from eventspark.functions.numeric import derived_mean, derived_std, fdiv, float_text
from eventspark.sources.tables import ORDER


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _stats(meta: DataFrame, keys: list[str], more: list[Column], float32: bool) -> DataFrame:
    has = meta.columns
    mean = _c("values/mean") if "values/mean" in has else derived_mean(_c("values/sum"), _c("values/n_occurrences"), float32)
    std = _c("values/std") if "values/std" in has else derived_std(_c("values/sum"), _c("values/sum_sqd"), _c("values/n_occurrences"), float32)
    return meta.select(*[_c(k).alias(f"__k{i}") for i, k in enumerate(keys)], *more, mean.alias("__mean"), std.alias("__std"))


def normalization(df: DataFrame, code_metadata: DataFrame, code_modifiers: list[str] | None = None, float32: bool = False) -> DataFrame:
    """``subject_id, time, code`` (vocabulary index) and ``numeric_value`` (z-score); rows without metadata go. Keys
    match null with null."""
    keys = ["code", *(code_modifiers or [])]
    meta = _stats(code_metadata, keys, [_c("code/vocab_index").alias("__vocab")], float32)
    on = reduce(lambda a, b: a & b, [_c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    z = fdiv(F.col("numeric_value") - F.col("__mean"), F.col("__std")).cast("float")
    order = [ORDER] if ORDER in df.columns else []
    return df.join(meta, on).select("subject_id", "time", F.col("__vocab").alias("code"), z.alias("numeric_value"), *order)


def normalization_in_blocks(df: DataFrame, blocks: list[dict[str, Any]], code_metadata: DataFrame, code_modifiers: list[str] | None = None, float32: bool = False) -> DataFrame:
    """Rows of a block normalized, those of no block as they are. Both stand in one table, so the input's columns have
    to be those of a normalized row, with codes as numbers."""
    given = [c for c in df.columns if c not in (ORDER, BLOCK)]
    if sorted(given) != ["code", "numeric_value", "subject_id", "time"] or not isinstance(df.schema["code"].dataType, T.NumericType):
        raise ValueError(f"Rows of no block stand beside normalized ones, which have subject_id, time, code (a number) and numeric_value; the rows have {given}, with codes of {df.schema['code'].dataType.simpleString()}")
    keys = ["code", *(code_modifiers or [])]
    meta = _stats(code_metadata, keys, [_c("code/vocab_index").alias("__vocab"), F.lit(True).alias("__known")], float32)
    on = reduce(lambda a, b: a & b, [_c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col(BLOCK) < len(blocks))
    own = F.col(BLOCK) < len(blocks)
    z = fdiv(F.col("numeric_value") - F.col("__mean"), F.col("__std")).cast("float").cast(df.schema["numeric_value"].dataType)
    new = {"code": F.when(own, F.col("__vocab").cast(df.schema["code"].dataType)).otherwise(F.col("code")), "numeric_value": F.when(own, z).otherwise(F.col("numeric_value"))}
    return df.join(meta, on, "left").where(~own | F.col("__known")).withColumns(new).select(*df.columns)


def occlude_outliers(df: DataFrame, code_metadata: DataFrame, stddev_cutoff: float | None = 4.5, code_modifiers: list[str] | None = None, float32: bool = False) -> DataFrame:
    """Values further than ``stddev_cutoff`` deviations from their code's mean become null; adds
    ``numeric_value/is_inlier`` (null where unknown). A code without metadata loses its value."""
    if stddev_cutoff is None:
        return df
    keys = ["code", *(code_modifiers or [])]
    meta = _stats(code_metadata, keys, [], float32)
    on = reduce(lambda a, b: a & b, [_c(k) == F.col(f"__k{i}") for i, k in enumerate(keys)])
    inlier = F.abs(F.col("numeric_value") - F.col("__mean")) <= F.lit(float(stddev_cutoff)) * F.col("__std")
    out = df.join(meta, on, "left").withColumns({"numeric_value/is_inlier": inlier, "numeric_value": F.when(inlier, F.col("numeric_value"))})
    return out.drop("__mean", "__std", *[f"__k{i}" for i in range(len(keys))])


def occlude_outliers_in_blocks(df: DataFrame, blocks: list[dict[str, Any]], code_metadata: DataFrame, code_modifiers: list[str] | None = None, float32: bool = False) -> DataFrame:
    """Each block with its own cutoff (null: rows as they are); the metadata is joined once. Rows of no block keep their
    ``numeric_value/is_inlier``, which the input therefore has to have."""
    cuts = [b.get("stddev_cutoff") for b in blocks]
    if all(c is None for c in cuts):
        return df
    if "numeric_value/is_inlier" not in df.columns:
        raise ValueError("Rows of no block would lack the new columns ['numeric_value/is_inlier']")
    keys = ["code", *(code_modifiers or [])]
    meta = _stats(code_metadata, keys, [], float32)
    on = reduce(lambda a, b: a & b, [_c(k) == F.col(f"__k{i}") for i, k in enumerate(keys)])
    cut = by_block([F.lit(c if c is None else float(c)).cast("double") for c in cuts], F.lit(None).cast("double"))
    inlier, own = F.abs(F.col("numeric_value") - F.col("__mean")) <= cut * F.col("__std"), cut.isNotNull()
    new = {"numeric_value/is_inlier": F.when(own, inlier).otherwise(_c("numeric_value/is_inlier")), "numeric_value": F.when(~own | inlier, F.col("numeric_value"))}
    return df.join(meta, on, "left").withColumns(new).select(*[_c(c) for c in df.columns])


def _endpoints(meta: DataFrame, name: str, kind: T.DataType) -> Column:
    if name not in meta.columns:
        raise ValueError(f"The code metadata has no column '{name}' to bin with")
    t = meta.schema[name].dataType
    if isinstance(t, T.StructType):
        if not all(isinstance(f.dataType, T.NumericType) for f in t.fields):
            raise ValueError(f"The bin column '{name}' must hold numbers only")
        return F.when(_c(name).isNotNull(), F.array(*[_c(name)[f.name].cast(kind) for f in t.fields]))
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
        return F.transform(_c(name), lambda x: x.cast(kind))
    raise ValueError(f"The bin column '{name}' must be a struct or an array of numbers, not {t.simpleString()}")


def ends_up_to(ends: Column, v: Column, few: int = 16) -> Column:
    """How many of the ascending ``ends`` are at most ``v``. Beyond ``few`` of them a search halves what is left at each
    step; below, counting is faster."""
    n = F.size(ends)
    steps = F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        more = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when((more <= n) & (F.get(ends, more - 1) <= v), more).otherwise(at)

    return F.when(n <= few, F.size(F.filter(ends, lambda e: e <= v))).otherwise(F.aggregate(steps, F.lit(0), step))


def bin_numeric_values(df: DataFrame, code_metadata: DataFrame, bin_with_columns: list[str] | None = None, code_with_bin_name: str = "{code}//value_[{left},{right})", custom_bins: dict[str, Any] | None = None, drop_numeric_value: bool = False, code_modifiers: list[str] | None = None) -> DataFrame:
    """Codes of rows with a value and bins get the bin's name; ``custom_bins`` (code -> endpoints) go before the
    columns, in the order given; endpoints ascend. A value on an endpoint belongs to the bin that starts there."""
    cfg = {"bin_with_columns": bin_with_columns, "code_with_bin_name": code_with_bin_name, "custom_bins": custom_bins, "drop_numeric_value": drop_numeric_value}
    return _binned(df, [cfg], code_metadata, code_modifiers, lambda values, rest: values[0])


def bin_numeric_values_in_blocks(df: DataFrame, blocks: list[dict[str, Any]], code_metadata: DataFrame, code_modifiers: list[str] | None = None) -> DataFrame:
    """Each block with its own bins and names; the metadata is joined once and each value searched for once."""
    return _binned(df, blocks, code_metadata, code_modifiers, by_block)


def _ends_of(meta: DataFrame, kind: T.DataType, names: list[str] | None, custom_bins: dict[str, Any] | None) -> Column:
    """A code's endpoints: the custom ones if it has any, else those of the first column that has some."""
    found = [_endpoints(meta, n, kind) for n in (names if names is not None else ["values/quantiles"])]
    if custom_bins:
        custom: Column = F.lit(None).cast(T.ArrayType(kind))
        for code, bins in custom_bins.items():
            ends = [float(x) for x in (bins.values() if isinstance(bins, dict) else bins)]
            custom = F.when(F.col("code") == code, F.array(*[F.lit(x).cast("float").cast(kind) for x in ends])).otherwise(custom)
        found.insert(0, custom)
    return F.coalesce(*found)


def _binned(df: DataFrame, blocks: list[dict[str, Any]], code_metadata: DataFrame, code_modifiers: list[str] | None, pick: Callable[[list[Column], Column], Column]) -> DataFrame:
    """``pick`` chooses a row's value from those of the blocks, or the one for rows of no block."""
    if "numeric_value" not in df.columns:
        raise ValueError("The data has no column 'numeric_value'")
    kind, keys = df.schema["numeric_value"].dataType, ["code", *(code_modifiers or [])]
    bins = [_ends_of(code_metadata, kind, b.get("bin_with_columns"), b.get("custom_bins")).alias(f"__ends{i}") for i, b in enumerate(blocks)]
    meta = code_metadata.select(*[_c(k).alias(f"__k{i}") for i, k in enumerate(keys)], *bins)
    on = reduce(lambda a, b: a & b, [_c(k) == F.col(f"__k{i}") for i, k in enumerate(keys)])
    v, ends, at = F.col("numeric_value"), F.col("__ends"), F.col("__at")
    fields = {"code": F.col("code"), "bin": at.cast("string"), "left": F.coalesce(float_text(F.get(ends, at - 1)), F.lit("-inf")), "right": F.coalesce(float_text(F.get(ends, at)), F.lit("inf"))}
    name = pick([_named(b["code_with_bin_name"], fields) for b in blocks], F.col("code"))
    do = ends.isNotNull() & v.isNotNull()
    new = {"code": F.when(do, name).otherwise(F.col("code"))}
    if any(b.get("drop_numeric_value") for b in blocks):
        new["numeric_value"] = F.when(~(do & pick([F.lit(bool(b.get("drop_numeric_value"))) for b in blocks], F.lit(False))), v)
    own = pick([F.col(f"__ends{i}") for i in range(len(blocks))], F.lit(None).cast(T.ArrayType(kind)))
    found = df.join(meta, on, "left").withColumn("__ends", own).withColumn("__at", F.when(do, ends_up_to(ends, v)))
    return found.withColumns(new).drop("__ends", "__at", *meta.columns)


def _named(pattern: str, fields: dict[str, Column]) -> Column:
    parts, at = [], 0
    for m in re.finditer(r"\{([^{}]*)\}", pattern):
        if m[1] not in fields:
            raise ValueError(f"Invalid bin name field '{m[1]}' in '{pattern}'. Known: {', '.join(fields)}")
        parts += [F.lit(pattern[at : m.start()]), fields[m[1]]]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


#: Types that extracted columns of these names must have.
REQUIRED_TYPES = {"subject_id": "long", "time": "timestamp", "code": "string", "numeric_value": "float", "text_value": "string", "categorical_value": "string"}


def extract_values(df: DataFrame, columns: dict[str, Any]) -> DataFrame:
    """Adds or replaces columns by expressions, all of which see the input's values; casts are strict."""
    return df.withColumns(extracted(df, columns))


def extracted(df: DataFrame, columns: dict[str, Any]) -> dict[str, Column]:
    """The columns that ``extract_values`` adds or replaces."""
    new, need = {}, set()
    for name, e in columns.items():
        if not isinstance(name, str):
            raise ValueError(f"Invalid column name: {name!r}")
        try:
            value, cols = dsl.expression(e)
        except ValueError as why:
            raise ValueError(f"Error building expression for {name}") from why
        if name in ("subject_id", "time"):
            warnings.warn(f"{name} is extracted as a value; this is hardly ever meant", stacklevel=2)
        new[name] = value.cast(REQUIRED_TYPES[name]) if name in REQUIRED_TYPES else value
        need |= cols
    if missing := need - set(df.columns):
        raise ValueError(f"Missing columns: {sorted(missing)}")
    return new


def code_order(code: Column, patterns: list[str]) -> Column:
    """Index of the first pattern that matches, else their number."""
    out = F.lit(len(patterns))
    for i in reversed(range(len(patterns))):
        out = F.when(code.rlike(patterns[i]), F.lit(i)).otherwise(out)
    return F.when(code.isNotNull(), out)


def reorder_measurements(df: DataFrame, code_metadata: DataFrame, ordered_code_patterns: list[str] | None = None, code_modifiers: list[str] | None = None, index_name: str | None = None) -> DataFrame:
    """Rows of one subject and time go by the first pattern their code matches; codes without metadata come first.
    The order is carried in the plan's order column; ``index_name`` also shows the index."""
    if not ordered_code_patterns:
        return df
    keys = ["code", *(code_modifiers or [])]
    meta = code_metadata.select(*[_c(k).alias(f"__k{i}") for i, k in enumerate(keys)], code_order(F.col("code"), ordered_code_patterns).alias("__idx")).distinct()
    on = reduce(lambda a, b: a & b, [_c(k) == F.col(f"__k{i}") for i, k in enumerate(keys)])
    out = df.join(meta, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    if ORDER in df.columns:
        out = out.withColumn(ORDER, F.struct(F.col("__idx").alias("b"), F.col(ORDER).alias("o")))
    return out.withColumnRenamed("__idx", index_name) if index_name else out.drop("__idx")


def reorder_measurements_in_blocks(df: DataFrame, blocks: list[dict[str, Any]], code_metadata: DataFrame, code_modifiers: list[str] | None = None) -> DataFrame:
    """Each block with its own patterns; the metadata is joined once. Rows of no block keep their order."""
    if any(b.get("index_name") for b in blocks):
        raise ValueError("Rows of no block would lack the column 'index_name' asks for")
    patterns = [b.get("ordered_code_patterns") for b in blocks]
    if ORDER not in df.columns or not any(patterns):
        return df
    keys = ["code", *(code_modifiers or [])]
    places = [(code_order(F.col("code"), p) if p else F.lit(0)).alias(f"__idx{i}") for i, p in enumerate(patterns)]
    meta = code_metadata.select(*[_c(k).alias(f"__k{i}") for i, k in enumerate(keys)], *places).distinct()
    on = reduce(lambda a, b: a & b, [_c(k) == F.col(f"__k{i}") for i, k in enumerate(keys)])
    place = by_block([F.col(f"__idx{i}") if p else F.lit(0) for i, p in enumerate(patterns)], F.lit(0))
    return df.join(meta, on, "left").withColumn(ORDER, F.struct(place.alias("b"), F.col(ORDER).alias("o"))).drop(*meta.columns)
