"""Per-code statistics, metadata merges and vocabulary indices."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from eventspark.functions.numbering import ordered
from eventspark.functions.numeric import present
from eventspark.operators import sketches

_QUANTILES = "values/quantiles"


def _v() -> Column:
    return F.col("numeric_value").cast("double")


def _ok() -> Column:
    return present(F.col("numeric_value"))


#: name -> aggregate of measurement rows. Users may add their own.
AGGREGATES: dict[str, Callable[[], Column]] = {
    "code/n_subjects": lambda: F.count_distinct("subject_id"),
    "code/n_occurrences": lambda: F.count(F.lit(1)),
    "values/n_subjects": lambda: F.count_distinct(F.when(_ok(), F.col("subject_id"))),
    "values/n_occurrences": lambda: F.count_if(_ok()),
    "values/n_ints": lambda: F.count_if(_ok() & (F.rint(_v()) == _v())),
    "values/sum": lambda: F.coalesce(F.sum(F.when(_ok(), _v())), F.lit(0.0)),
    "values/sum_sqd": lambda: F.coalesce(F.sum(F.when(_ok(), _v() * _v())), F.lit(0.0)),
    "values/min": lambda: F.min(F.when(_ok(), F.col("numeric_value"))),
    "values/max": lambda: F.max(F.when(_ok(), F.col("numeric_value"))),
}
#: How partial results of rows' disjoint parts become one; the two counts of subjects follow from parts by subject.
MERGES: dict[str, Callable[[Column], Column]] = {**{n: F.sum for n in ("code/n_occurrences", "values/n_occurrences", "values/n_ints", "values/sum", "values/sum_sqd")}, "values/min": F.min, "values/max": F.max}
SUBJECTS: dict[str, Callable[[], Column]] = {
    "code/n_subjects": lambda: F.count("subject_id"),
    "values/n_subjects": lambda: F.count(F.when(F.col("`values/n_occurrences`") > 0, F.col("subject_id"))),
}


def partial_states(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """One row per ``by`` with the partial results that ``merged_states`` needs for the aggregates ``names``."""
    need = [n for n in MERGES if n in names or n == "values/n_occurrences" and "values/n_subjects" in names] or ["code/n_occurrences"]
    return df.groupBy(*by).agg(*[AGGREGATES[n]().alias(n) for n in need])


def merged_states(parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Aggregates ``names`` by ``keys``. Subjects are counted if asked for: parts must then be by keys and subject_id,
    each once."""
    empty = {"values/sum": 0.0, "values/sum_sqd": 0.0, **dict.fromkeys(("code/n_occurrences", "values/n_occurrences", "values/n_ints"), 0)}

    def one(n: str) -> Column:
        if n in SUBJECTS:
            return SUBJECTS[n]().alias(n)
        got = MERGES[n](F.col(f"`{n}`"))
        return (F.coalesce(got, F.lit(empty[n])) if n in empty else got).alias(n)

    return parts.groupBy(*keys).agg(*[one(n) for n in names])


def parse_aggregations(specs: list) -> list[tuple[str, dict]]:
    out = []
    for s in specs:
        name, kw = (s, {}) if isinstance(s, str) else (s.get("name"), {k: v for k, v in s.items() if k != "name"})
        if name not in AGGREGATES and name != _QUANTILES and name not in sketches.NAMES:
            raise ValueError(f"Unknown aggregation '{name}'. Known: {', '.join([*AGGREGATES, _QUANTILES, *sketches.NAMES])}")
        out.append((name, kw))
    return out


def aggregate_code_metadata(df: DataFrame, aggregations: list, do_summarize_over_all_codes: bool = False, code_modifiers: list[str] | None = None, float32: bool = False) -> DataFrame:
    """One row per code (and modifiers), and one with null keys over all codes if asked for, also for empty input."""
    modifiers = code_modifiers or []
    if not isinstance(modifiers, list) or not all(isinstance(m, str) for m in modifiers):
        raise ValueError(f"code_modifiers must be a list of column names, not {code_modifiers!r}")
    specs = parse_aggregations(aggregations)
    keys = ["code", *modifiers]
    return summarized(lambda by: _aggregate(df, by, specs, keys), keys, df.schema, do_summarize_over_all_codes, float32)


def summarized(of: Callable[[list[str]], DataFrame], keys: list[str], schema: StructType, with_total: bool, float32: bool) -> DataFrame:
    """``of(keys)``, with ``of([])`` under null keys if asked for, doubles rounded to single precision if asked for."""
    out = of(keys)
    if with_total:
        total = of([])
        out = out.unionByName(total.select(*[F.lit(None).cast(schema[k].dataType).alias(k) for k in keys], *[F.col(f"`{c}`") for c in total.columns]))
    if float32:
        out = out.withColumns({f.name: F.col(f"`{f.name}`").cast("float") for f in out.schema if f.dataType.typeName() == "double"})
    return out


def _aggregate(df: DataFrame, by: list[str], specs: list[tuple[str, dict]], keys: list[str]) -> DataFrame:
    """Aggregates by ``by``, which is ``keys`` or nothing. A row over all codes comes from the same partial results by
    ``keys``, so that it costs no further scan: Spark reuses their shuffle."""
    plain = [n for n, _ in specs if n in AGGREGATES] or ["code/n_occurrences"]
    total = by != keys
    if any(n not in SUBJECTS and n not in MERGES for n in plain):  # a user's own
        out = df.groupBy(*by).agg(*[AGGREGATES[n]().alias(n) for n in plain])
    elif any(n in SUBJECTS for n in plain):
        # By subject first: distinct counts beside plain aggregates would multiply the rows before they are shuffled.
        parts = partial_states(df, [*keys, "subject_id"], plain)
        if total:  # a subject's codes become one part
            parts = merged_states(parts, [*by, "subject_id"], [c for c in parts.columns if c in MERGES])
        out = merged_states(parts, by, plain)
    elif total:
        out = merged_states(partial_states(df, keys, plain), by, plain)
    else:
        out = df.groupBy(*by).agg(*[AGGREGATES[n]().alias(n) for n in plain])

    def counts() -> DataFrame:
        counted = value_counts(df, keys)
        return counted.groupBy(*by, "__v").agg(F.sum("__c").alias("__c")) if total else counted

    return with_others(out, by, specs, counts, lambda: sketches.sketch_states(df, by))


def with_others(out: DataFrame, keys: list[str], specs: list[tuple[str, dict]], counts: Callable[[], DataFrame], sketched: Callable[[], DataFrame]) -> DataFrame:
    """``out`` with what ``specs`` ask for besides: quantiles of the counted values, estimates from sketches. Columns are
    in the order of ``specs``."""
    quantiles = next((kw.get("quantiles", []) for n, kw in specs if n == _QUANTILES), None)
    if quantiles is not None:
        q = value_quantiles(counts(), keys, quantiles)
        if keys:
            on = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])
            out = out.alias("l").join(q.alias("r"), on, "left").select("l.*", F.col(f"r.`{_QUANTILES}`").alias(_QUANTILES))
        else:  # two single rows become one
            both = out.unionByName(q, allowMissingColumns=True)
            out = both.agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in both.columns])
    order = [*keys, *[n for n, _ in specs]]
    if approx := {n: kw for n, kw in specs if n in sketches.NAMES}:
        found = sketches.estimates(sketched(), keys, list(approx), approx.get(sketches.QUANTILES, {}).get("quantiles"))
        return sketches.joined(out, found, keys, order)
    return out.select(*[F.col(f"`{c}`") for c in order])


def _chunk_of(v: Column) -> Column:
    """A whole number that doesn't fall as ``v`` grows: 256 to an octave."""
    size = F.abs(v.cast("double"))
    step = F.when(size == float("inf"), F.lit(1 << 20)).otherwise(F.floor(F.log2(size) * 256) + (1 << 19))
    return F.when(size == 0, F.lit(0)).otherwise(F.signum(v.cast("double")).cast("long") * step)


def value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """How often each present value stands by key: ``__v``, ``__c``."""
    return df.where(_ok()).groupBy(*keys, F.col("numeric_value").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))


def value_quantiles(counts: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """Exact nearest-rank quantiles (ties up) of counted values (``value_counts``, each value of a key once) as a struct
    ``values/quantiles``.

    Repeated values have shrunk before they meet. They are cut into chunks that follow their order; the chunks' own
    counts tell which of them hold a wanted rank, and only there a running count over the ordered values finds it. So no
    task orders all values of a key, or of the whole table.
    """
    counts = counts.withColumn("__chunk", _chunk_of(F.col("__v")))
    chunks = counts.groupBy(*keys, "__chunk").agg(F.sum("__c").alias("__of"))
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # over chunks, of which there are few
    chunks = chunks.withColumns({"__n": F.sum("__of").over(key), "__start": F.coalesce(F.sum("__of").over(key.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ranks = [F.floor(F.lit(float(q)) * (F.col("__n") - 1) + F.lit(0.5)) for q in quantiles]
    inside = [(r >= F.col("__start")) & (r < F.col("__start") + F.col("__of")) for r in ranks]
    chunks = chunks.where(reduce(lambda a, b: a | b, inside, F.lit(False)) | (F.col("__start") == 0)).withColumns({f"__r{i}": F.when(t, r) for i, (t, r) in enumerate(zip(inside, ranks, strict=True))})
    on = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys], F.col("l.__chunk") == F.col("r.__chunk"))
    found = counts.alias("l").join(chunks.alias("r"), on).select("l.*", "__start", *[f"__r{i}" for i in range(len(ranks))])
    upto = Window.partitionBy(*keys, "__chunk").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("__hi", F.col("__start") + F.sum("__c").over(upto))
    picked = [F.min(F.when(F.col("__hi") > F.col(f"__r{i}"), F.col("__v"))).alias(f"__q{i}") for i in range(len(ranks))]
    names = [F.col(f"__q{i}").alias(f"values/quantile/{q}") for i, q in enumerate(quantiles)]
    out = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k"), *picked)
    return out.where("__k > 0").select(*[F.col(f"`{k}`") for k in keys], F.struct(*names).alias(_QUANTILES))


def merge_metadata(new: DataFrame, old: DataFrame, code_modifiers: list[str] | None = None) -> DataFrame:
    """``new`` with the columns that only ``old`` has; codes that only ``old`` has are dropped, null keys don't match."""
    keys = ["code", *[m for m in (code_modifiers or []) if m in old.columns]]
    more = [c for c in old.columns if c not in new.columns]
    return new.join(old.select(*[F.col(f"`{c}`") for c in [*keys, *more]]), keys, "left") if more else new


def with_all_columns(parts: DataFrame, needed: list[str]) -> DataFrame:
    """The partial results of a user's map step, if they have every column that its reduce step reads."""
    if gone := [c for c in needed if c not in parts.columns]:
        raise ValueError(f"The mapped rows lack {gone}, which their reduction reads. They have {parts.columns}")
    return parts


def fit_vocabulary_indices(code_metadata: DataFrame, ordering_method: str = "lexicographic", code_modifiers: list[str] | None = None) -> DataFrame:
    """Adds ``code/vocab_index``: 1, 2, ... in lexicographic order of the keys, nulls first; 0 is left for unknown.

    Keys are ranked in ranges between sampled splitters (``ordered``), whatever their prefixes, so no task holds all
    codes. Keys that stand twice raise a ``ValueError`` that names up to 100 of them, the most frequent first.
    """
    if ordering_method != "lexicographic":
        raise ValueError(f"Invalid ordering method: {ordering_method}. Known: lexicographic")
    names = ["code", *(code_modifiers or [])]
    keys = [F.col(f"`{k}`") for k in names]
    placed = ordered(code_metadata, [k.asc_nulls_first() for k in keys], "code/vocab_index", "vocabulary")
    twice = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").orderBy(F.desc("__n"), *keys).limit(100).collect()
    if twice:
        raise ValueError(f"The code and modifiers must be unique; these are not: {[tuple(r) for r in twice]}")
    return placed.withColumn("code/vocab_index", (F.col("`code/vocab_index`") + 1).cast("int"))
