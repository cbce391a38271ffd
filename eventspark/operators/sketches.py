"""Approximate code statistics from mergeable sketches, for those who ask for them; exact ones are the default.

Subjects are counted by HyperLogLog (``lg_k`` 12: a relative standard error of 1.6 %), quantiles come from KLL sketches
(``k`` 200: a rank error of about 1.3 %, with a confidence of 99 %). A sketch has a bounded size whatever the rows, so partial
results by file need no sets of subjects and no counts of values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.numeric import present

CODE_SUBJECTS, VALUE_SUBJECTS, QUANTILES = "approx/code/n_subjects", "approx/values/n_subjects", "approx/values/quantiles"
NAMES = (CODE_SUBJECTS, VALUE_SUBJECTS, QUANTILES)
LG_K, K = 12, 200


def sketch_states(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per ``by`` with its sketches: of subjects, of subjects with a value, of present values."""
    ok, v = present(F.col("numeric_value")), F.col("numeric_value").cast("double")
    aggs = {CODE_SUBJECTS: F.hll_sketch_agg(F.col("subject_id"), LG_K), VALUE_SUBJECTS: F.hll_sketch_agg(F.when(ok, F.col("subject_id")), LG_K), QUANTILES: F.kll_sketch_agg_double(F.when(ok, v), K)}
    return df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])


def merged_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    union = {CODE_SUBJECTS: F.hll_union_agg, VALUE_SUBJECTS: F.hll_union_agg, QUANTILES: F.kll_merge_agg_double}
    return parts.groupBy(*keys).agg(*[f(F.col(f"`{n}`")).alias(n) for n, f in union.items()])


def estimates(sketched: DataFrame, keys: list[str], names: list[str], quantiles: list[float] | None) -> DataFrame:
    """The aggregates ``names`` of each row's sketches; quantiles are a struct, null where no value is present."""
    s = F.col(f"`{QUANTILES}`")
    q = F.struct(*[F.kll_sketch_get_quantile_double(s, F.lit(float(x))).alias(f"values/quantile/{x}") for x in quantiles or []])
    made: dict[str, Column] = {n: F.coalesce(F.hll_sketch_estimate(f"`{n}`"), F.lit(0)) for n in (CODE_SUBJECTS, VALUE_SUBJECTS)}
    made[QUANTILES] = F.when(F.coalesce(F.kll_sketch_get_n_double(s), F.lit(0)) > 0, q)
    return sketched.select(*[F.col(f"`{k}`") for k in keys], *[made[n].alias(n) for n in names])


def joined(exact: DataFrame, approx: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Both results of each key beside each other."""
    if keys:
        on = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])
        out = exact.alias("l").join(approx.alias("r"), on, "left").select("l.*", *[F.col(f"r.`{c}`") for c in approx.columns if c not in keys])
    else:  # two single rows become one
        both = exact.unionByName(approx, allowMissingColumns=True)
        out = both.agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in both.columns])
    return out.select(*[F.col(f"`{c}`") for c in order])
