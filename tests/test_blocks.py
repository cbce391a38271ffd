"""Match and revise on any map stage: all blocks in one plan give what each block by itself gives."""

import pytest
from base_data import events, in_order
from pyspark.sql import functions as F

from eventspark.operators.codes import aggregate_code_metadata, fit_vocabulary_indices
from eventspark.operators.match_revise import MODES, match_revise
from eventspark.plans.pipeline import Pipeline, parse_stages
from eventspark.plans.registry import builtin

HEART, TEMP, OTHER = {"code": {"regex": "^HR"}}, {"code": {"regex": "TEMP|^H"}}, {"code": {"regex": "^(ADM|MEDS|DIS)"}}
CASES = {
    "filter_subjects": ([{"min_measurements_per_subject": 4}, {"min_events_per_subject": 4, "min_measurements_per_subject": 2}, {}], {}),
    "filter_measurements": ([{"min_occurrences_per_code": 13}, {"min_subjects_per_code": 3, "min_occurrences_per_code": 2}, {}], {}),
    "drop_regex": ([{"regex": "HR"}, {"regex": "TEMP"}, {}], {}),
    "occlude_outliers": ([{"stddev_cutoff": 1}, {"stddev_cutoff": None}, {"stddev_cutoff": 2}], {}),
    "bin_numeric_values": ([{"code_with_bin_name": "{code}:{bin}"}, {"custom_bins": {"TEMP": [96, 99.9], "HR": {"a": 100}}}, {"bin_with_columns": ["values/quantiles"]}], {"drop_numeric_value": True}),
    "reorder_measurements": ([{"ordered_code_patterns": ["HR"]}, {"ordered_code_patterns": ["TEMP", "HEIGHT"]}, {}], {}),
    "add_time_derived_measurements": ([{"age": {"DOB_code": "MEDS_BIRTH"}}, {"age": None, "timeline_tokens": {"time_unit": "h"}}, {"age": {"DOB_regex": "^MEDS", "age_unit": "d", "age_code": "DAYS"}, "timeline_tokens": {"time_unit": "d", "timeline_end_code": "DISCHARGE"}}], {"time_of_day": None}),
    "normalization": ([{}, {}, {}], {}),
}


def metadata(df):
    stats = aggregate_code_metadata(df, ["code/n_subjects", "code/n_occurrences", "values/n_occurrences", "values/sum", "values/sum_sqd", {"name": "values/quantiles", "quantiles": [0.25, 0.5, 0.75]}])
    return fit_vocabulary_indices(stats.where("code <> 'DISCHARGE'"))


def rows_for(spark, name):
    df = events(spark)
    if name == "occlude_outliers":
        return df.withColumn("numeric_value/is_inlier", F.lit(None).cast("boolean"))
    return df


def shown(df):
    return sorted(repr(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("name", [n for n in CASES if n != "normalization"])
def test_together_as_apart(spark, name, mode):
    df = rows_for(spark, name)
    meta, stage, (own, shared) = metadata(events(spark)).cache(), builtin()[name], CASES[name]
    blocks = [{"_matcher": m, **s} for m, s in zip((HEART, TEMP, OTHER), own, strict=True)]
    given = lambda d: {"df": d, "code_metadata": meta, "code_modifiers": None, "float32": False}

    apart = lambda d, s: stage.bind(s, given(d))
    one = match_revise(df, blocks, apart, shared, mode, together=lambda d, each: stage.bind_blocks(each, given(d)))
    assert one.columns == df.columns and one.count() > 20
    if name in ("add_time_derived_measurements", "reorder_measurements"):  # parts have orders of different forms
        one, df = one.drop("__ord"), df.drop("__ord")
    two = match_revise(df, blocks, apart, shared, mode)
    assert shown(one) == shown(two.select(*[F.col(f"`{c}`") for c in one.columns]))
    meta.unpersist()


def test_normalized_blocks(spark):
    """Codes are numbers already; rows of no block keep theirs."""
    df = events(spark).withColumn("code", F.when(F.col("code") == "HR", 7).when(F.col("code") == "TEMP", 9).otherwise(1))
    meta = aggregate_code_metadata(df, ["values/n_occurrences", "values/sum", "values/sum_sqd"]).where("code <> 1").withColumn("code/vocab_index", F.col("code") * 10)
    blocks = [{"_matcher": {"code": 7}}, {"_matcher": {"code": 9}}]
    given = lambda d: {"df": d, "code_metadata": meta, "code_modifiers": None, "float32": False}
    stage = builtin()["normalization"]
    one = match_revise(df, blocks, None, {}, together=lambda d, each: stage.bind_blocks(each, given(d)))
    two = match_revise(df, blocks, lambda d, s: stage.bind(s, given(d)))
    assert shown(one) == shown(two.select(*one.columns))
    assert {r["code"] for r in one.collect()} == {1, 70, 90}
    with pytest.raises(ValueError, match="beside normalized ones"):
        stage.bind_blocks([{}], given(events(spark).withColumn("__block", F.lit(0))))


@pytest.mark.parametrize("name", list(CASES))
def test_input_is_read_once(spark, tmp_path, name):
    """Three blocks make one scan of the rows (two where births are looked for), and no union."""
    df = rows_for(spark, name).drop("__ord")
    if name == "normalization":
        df = df.withColumn("code", F.length("code"))
    df.write.parquet(str(tmp_path / "rows"))
    metadata(events(spark)).withColumn("code", F.length("code") if name == "normalization" else F.col("code")).write.parquet(str(tmp_path / "codes"))
    own, shared = CASES[name]
    matchers = [{"code": 2}, {"code": 4}, {"code": 9}] if name == "normalization" else [HEART, TEMP, OTHER]
    step = {name: {**shared, "_match_revise": [{"_matcher": m, **s} for m, s in zip(matchers, own, strict=True)]}}
    out, _ = Pipeline(parse_stages([step])).apply(spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "codes")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    reads = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Generate explode" in plan
    assert reads.count("/rows]") == (2 if name == "add_time_derived_measurements" else 1), reads


def test_order_of_blocks(spark):
    """Blocks in turn, each in its own order; rows of no block last."""
    df, meta = events(spark), metadata(events(spark))
    step = {"reorder_measurements": {"_match_revise": [{"_matcher": {"code": {"regex": "^TEMP|^ADM"}}, "ordered_code_patterns": ["TEMP", "ADM"]}, {"_matcher": {"code": "HEIGHT"}}]}}
    got = in_order(Pipeline(parse_stages([step])).apply(df, meta)[0], 239684)
    assert [r["code"] for r in got][:6] == ["HEIGHT", "EYE_COLOR//BROWN", "MEDS_BIRTH", "TEMP", "ADMISSION//CARDIAC", "HR"]
    step = {"add_time_derived_measurements": {"age": None, "time_of_day": None, "_match_revise": [{"_matcher": {"code": "HR"}, "timeline_tokens": {"time_unit": "min"}}, {"_matcher": {"code": "TEMP"}, "timeline_tokens": {"time_unit": "s", "timeline_start_code": None}}]}}
    got = in_order(Pipeline(parse_stages([step])).apply(df, meta)[0], 68729)
    assert [r["code"] for r in got][3:] == ["TIMELINE//START", "HR", "TIMELINE//END", "TEMP", "TIMELINE//END", "ADMISSION//PULMONARY", "DISCHARGE"]


def test_block_edges(spark):
    """A null matcher drops its rows, empty input stays empty, unknown settings and new columns are refused."""
    df = events(spark)
    run = lambda d, step: Pipeline(parse_stages([step])).apply(d, metadata(events(spark)))[0]
    null = df.withColumn("code", F.when(F.col("code") != "HR", F.col("code")))
    left = run(null, {"drop_regex": {"_match_revise": [{"_matcher": TEMP, "regex": "TEMP"}]}})
    assert left.where("code is null or code like 'TEMP%'").count() == 0 and left.count() == df.where("code not in ('HR', 'TEMP')").count()
    for name, (own, shared) in CASES.items():
        if name not in ("normalization", "occlude_outliers"):
            empty = run(df.limit(0), {name: {**shared, "_match_revise": [{"_matcher": HEART, **own[0]}]}})
            assert empty.count() == 0 and empty.columns == df.columns, name
    with pytest.raises(ValueError, match="no setting"):
        run(df, {"drop_regex": {"_match_revise": [{"_matcher": HEART, "regexp": "x"}]}})
    with pytest.raises(ValueError, match="new columns"):
        run(df, {"occlude_outliers": {"_match_revise": [{"_matcher": HEART}]}})
    with pytest.raises(ValueError, match="new columns"):
        run(df.drop("numeric_value"), {"add_time_derived_measurements": {"age": {"DOB_code": "MEDS_BIRTH"}, "_match_revise": [{"_matcher": {"code": {"regex": "."}}}]}})


def test_summary_row_costs_no_scan(spark, tmp_path):
    """The row over all codes comes from the partial results by code."""
    events(spark).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    for names in (["code/n_occurrences", "values/sum", "values/min"], ["code/n_subjects", "values/n_subjects", "values/n_ints"]):
        out = aggregate_code_metadata(df, names, do_summarize_over_all_codes=True)
        rows = {r["code"]: r for r in out.collect()}
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1 and "ReusedExchange" in final, final
        whole = aggregate_code_metadata(df.withColumn("code", F.lit("all")), names).first()
        assert [rows[None][n] for n in names] == [pytest.approx(whole[n]) for n in names]
        empty = aggregate_code_metadata(df.limit(0), names, do_summarize_over_all_codes=True).collect()
        assert len(empty) == 1 and empty[0][names[0]] == 0
