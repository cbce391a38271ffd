import math
from datetime import datetime, timedelta

import pytest
from base_data import events, in_order, splits
from pyspark.sql import functions as F

from eventspark.functions import dsl
from eventspark.functions.numeric import fdiv, float_text
from eventspark.functions.units import time_unit
from eventspark.operators import codes, filters, shards, timeline, values
from eventspark.operators.match_revise import match_revise
from eventspark.sources.tables import of_split, wide_to_events

ALL = ["code/n_occurrences", "code/n_subjects", "values/n_occurrences", "values/n_subjects", "values/sum", "values/sum_sqd", "values/n_ints", "values/min", "values/max", {"name": "values/quantiles", "quantiles": [0.25, 0.5, 0.75]}]


def by_code(df):
    return {r["code"]: r for r in df.collect()}


def test_fdiv(spark):
    rows = [(1.0, 0.0, math.inf), (0.0, 0.0, math.nan), (-1.0, 0.0, -math.inf), (3.0, 2.0, 1.5), (None, 0.0, None), (math.nan, 0.0, math.nan)]
    got = [r[0] for r in spark.createDataFrame([x[:2] for x in rows], "a double, b double").select(fdiv(F.col("a"), F.col("b"))).collect()]
    for g, (_, _, want) in zip(got, rows, strict=True):
        assert g == want or (want is not None and math.isnan(want) and math.isnan(g))


def test_float_text(spark):
    got = [r[0] for r in spark.createDataFrame([(107.5,), (100.0,), (12345678.0,)], "v double").select(float_text(F.col("v"))).collect()]
    assert got == ["107.5", "100.0", "12345678.0"]


def test_units():
    assert time_unit("wks") == ("weeks", 604_800)
    assert time_unit("months")[1] == 2_629_746.0
    with pytest.raises(ValueError, match="Unknown time unit 'fortnight'"):
        time_unit("fortnight")


def test_aggregates_with_summary(spark):
    got = by_code(codes.aggregate_code_metadata(of_split(events(spark, False), splits(spark)), ALL, do_summarize_over_all_codes=True))
    total, hr, temp, adm = got[None], got["HR"], got["TEMP"], got["ADMISSION//CARDIAC"]
    assert (total["code/n_occurrences"], total["code/n_subjects"], total["values/n_occurrences"], total["values/n_ints"]) == (44, 4, 28, 6)
    assert total["values/sum"] == pytest.approx(3198.8389, rel=1e-6)
    assert tuple(total["values/quantiles"]) == pytest.approx((99.9, 105.1, 113.4))
    assert tuple(hr["values/quantiles"]) == pytest.approx((107.5, 112.5, 113.4))
    assert tuple(temp["values/quantiles"]) == pytest.approx((96.2, 99.9, 100.0))
    assert hr["values/sum_sqd"] == pytest.approx(158538.77, rel=1e-6)
    assert (adm["values/sum"], adm["values/min"], adm["values/quantiles"]) == (0, None, None)
    empty = codes.aggregate_code_metadata(events(spark, False).where("false"), ALL, do_summarize_over_all_codes=True).collect()
    assert len(empty) == 1
    assert (empty[0]["code/n_occurrences"], empty[0]["values/sum"], empty[0]["values/quantiles"]) == (0, 0.0, None)


def test_aggregates_mask_nan_and_keep_null_modifiers(spark):
    df = spark.createDataFrame([("A", None, 1, 1.0), ("A", None, 2, float("nan")), ("A", 1, 1, 2.5), ("A", 1, 1, None)], "code string, mod int, subject_id int, numeric_value double")
    got = {r["mod"]: r for r in codes.aggregate_code_metadata(df, ALL, code_modifiers=["mod"]).collect()}
    assert (got[None]["code/n_occurrences"], got[None]["values/n_occurrences"], got[None]["values/max"], got[None]["values/n_subjects"]) == (2, 1, 1.0, 1)
    assert (got[1]["values/sum"], got[1]["values/n_ints"], got[1]["values/quantiles"][1]) == (2.5, 0, 2.5)


def test_unknown_aggregate_and_modifiers():
    with pytest.raises(ValueError, match="Unknown aggregation"):
        codes.parse_aggregations(["code/median"])
    with pytest.raises(ValueError, match="code_modifiers"):
        codes.aggregate_code_metadata(None, [], code_modifiers=[1])


def test_merge_keeps_new_values(spark):
    new = spark.createDataFrame([("A", 1), ("B", 2)], "code string, a int")
    old = spark.createDataFrame([("A", 9, 5), ("C", 9, 6)], "code string, a int, b int")
    assert sorted(map(tuple, codes.merge_metadata(new, old).collect())) == [("A", 1, 5), ("B", 2, None)]


def test_vocabulary(spark):
    meta = spark.createDataFrame([("B", "x"), ("A", "y"), (None, None), ("A", None)], "code string, mod string")
    got = {(r["code"], r["mod"]): r["code/vocab_index"] for r in codes.fit_vocabulary_indices(meta, code_modifiers=["mod"]).collect()}
    assert got == {(None, None): 1, ("A", None): 2, ("A", "y"): 3, ("B", "x"): 4}
    with pytest.raises(Exception, match="unique"):  # once computed: the plan itself is lazy
        codes.fit_vocabulary_indices(meta).collect()
    many = spark.createDataFrame([(f"{i % 7}{'x' * (i % 9)}//{i}",) for i in range(300)] + [(None,), ("",)], "code string")
    order = [r["code"] for r in sorted(codes.fit_vocabulary_indices(many).collect(), key=lambda r: r["code/vocab_index"])]
    assert order == [None, *sorted(r["code"] for r in many.collect() if r["code"] is not None)]
    with pytest.raises(ValueError, match="ordering"):
        codes.fit_vocabulary_indices(meta, "random")


def test_subject_filters(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, None), (2, 1), (2, 2), (2, None), (3, None)], "subject_id int, time int")
    ids = lambda d: sorted({r["subject_id"] for r in d.collect()})
    assert ids(filters.filter_subjects(df, min_events_per_subject=2)) == [1, 2]
    assert ids(filters.filter_subjects(df, min_events_per_subject=3)) == [2]
    assert ids(filters.filter_subjects(df, min_measurements_per_subject=2)) == [1, 2]
    assert ids(filters.filter_subjects(df, 0, None)) == [1, 2, 3]
    with pytest.raises(TypeError):
        filters.filter_subjects(df, "5")
    got = {r["subject_id"] for r in filters.filter_subjects(events(spark), min_events_per_subject=5).collect()}
    assert got == {239684, 1195293, 1500733}


def test_measurement_filters(spark):
    df = events(spark, False)
    meta = codes.aggregate_code_metadata(df, ["code/n_subjects", "code/n_occurrences"])
    kept = {r["code"] for r in filters.filter_measurements(df, meta, min_subjects_per_code=3).collect()}
    assert kept == {"EYE_COLOR//BROWN", "HEIGHT", "MEDS_BIRTH", "HR", "TEMP", "DISCHARGE"}
    assert filters.filter_measurements(df, meta) is df
    assert {r["code"][0] for r in filters.drop_regex(df, "^[A-M]").collect()} == {"T"}


FEATURES = {"age": {"DOB_code": "MEDS_BIRTH", "age_code": "AGE", "age_unit": "years"}, "time_of_day": {"time_of_day_code": "TIME_OF_DAY", "endpoints": [6, 12, 18, 24]}, "timeline_tokens": {"time_unit": "y"}}


def test_time_derived_rows_and_their_order(spark):
    got = in_order(timeline.add_time_derived_measurements(events(spark), FEATURES), 239684)
    assert [r["code"] for r in got] == [
        *["EYE_COLOR//BROWN", "HEIGHT"],
        *["TIMELINE//START", "TIME_OF_DAY//[00,06)", "MEDS_BIRTH"],
        *["TIMELINE//DELTA//years", "TIME_OF_DAY//[12,18)", "AGE", "ADMISSION//CARDIAC", "HR", "TEMP"],
        *["TIMELINE//DELTA//years", "TIME_OF_DAY//[12,18)", "AGE", "HR", "TEMP"],
        *["TIMELINE//DELTA//years", "TIME_OF_DAY//[18,24)", "AGE", "HR", "TEMP"] * 2,
        *["TIMELINE//DELTA//years", "TIME_OF_DAY//[18,24)", "AGE", "DISCHARGE", "TIMELINE//END"],
    ]
    assert [r["numeric_value"] for r in got if r["code"] == "AGE"][:2] == pytest.approx([29.36883360, 29.36884681])


def test_time_derived_settings(spark):
    df = events(spark)
    assert timeline.add_time_derived_measurements(df, {"age": None}) is df
    with pytest.raises(ValueError, match="buzz"):
        timeline.add_time_derived_measurements(df, {"buzz": {}})
    for ends, why in (([], "at least one"), ([6, 30], "between"), ([6.5], "integer"), ([6, 6], "unique"), ([12, 6], "sorted")):
        with pytest.raises(ValueError, match=why):
            timeline.time_of_day(df, {"time_of_day_code": "T", "endpoints": ends})
    with pytest.raises(ValueError, match="DOB"):
        timeline.age(df, {"age_unit": "y"})
    assert timeline.timeline_tokens(df, {"timeline_start_code": None, "timeline_end_code": None, "time_delta_code": None}) is None


def test_two_births_make_two_ages(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp'2000-01-01', 'DOB'), (1, timestamp'2001-01-01', 'DOB//2'), (1, timestamp'2002-01-01', 'X') t(subject_id, time, code)")
    got = timeline.age(df, {"DOB_code": "DOB", "age_unit": "d"}).collect()
    assert sorted(r["numeric_value"] for r in got) == [365.0, 366.0, 731.0]


def test_normalization(spark):
    df = spark.createDataFrame([(1, "A", None, 3.0), (1, "A", "u", 3.0), (1, "Z", None, 1.0)], "subject_id int, code string, unit string, numeric_value double").withColumn("time", F.lit(None).cast("timestamp"))
    meta = spark.createDataFrame([("A", None, 1, 1.0, 2.0), ("A", "u", 2, 3.0, 0.0)], "code string, unit string, `code/vocab_index` int, `values/mean` double, `values/std` double")
    got = {r["code"]: r["numeric_value"] for r in values.normalization(df, meta, ["unit"]).collect()}
    assert got[1] == 1.0
    assert math.isnan(got[2])
    assert len(got) == 2


def test_outliers(spark):
    meta = spark.createDataFrame([("HR", 12, 1360.5, 158538.77), ("TEMP", 12, 1181.5, 116373.39), ("HEIGHT", 4, 656.8389, 108056.12937)], "code string, `values/n_occurrences` int, `values/sum` double, `values/sum_sqd` double")
    got = in_order(values.occlude_outliers(events(spark), meta, 1), 239684)
    assert [(r["code"], r["numeric_value/is_inlier"]) for r in got[:6]] == [("EYE_COLOR//BROWN", None), ("HEIGHT", False), ("MEDS_BIRTH", None), ("ADMISSION//CARDIAC", None), ("HR", True), ("TEMP", False)]
    assert values.occlude_outliers(events(spark), meta.where("code = 'HR'"), 9).where("code = 'TEMP' AND numeric_value IS NOT NULL").count() == 0


def test_bins(spark):
    meta = spark.sql("SELECT 'HR' AS code, named_struct('a', 107.5D, 'b', 112.5D, 'c', 113.4D) AS `values/quantiles` UNION ALL SELECT 'HEIGHT', named_struct('a', 160.39531D, 'b', 164.68689D, 'c', 164.68689D) UNION ALL SELECT 'TEMP', NULL")
    got = [r["code"] for r in in_order(values.bin_numeric_values(events(spark), meta), 239684)]
    assert got[1] == "HEIGHT//value_[164.68689,inf)"
    assert [c for c in got if c.startswith("HR")] == ["HR//value_[-inf,107.5)", "HR//value_[-inf,107.5)", "HR//value_[113.4,inf)", "HR//value_[112.5,113.4)"]
    assert "TEMP" in got
    own = values.bin_numeric_values(events(spark), meta, [], "{code}_{bin}", {"TEMP": {"x": 96}}, drop_numeric_value=True)
    assert [(r["code"], r["numeric_value"]) for r in in_order(own, 239684) if r["code"].startswith("TEMP")][:3] == [("TEMP_1", None), ("TEMP_1", None), ("TEMP_0", None)]
    with pytest.raises(ValueError, match="field"):
        values.bin_numeric_values(events(spark), meta, code_with_bin_name="{code}{what}")


def test_reorder(spark):
    meta = events(spark).select("code").distinct()
    out = values.reorder_measurements(events(spark), meta, ["ADMISSION.*", "TEMP", "HR"])
    assert [r["code"] for r in in_order(out, 239684)][3:8] == ["ADMISSION//CARDIAC", "TEMP", "HR", "TEMP", "HR"]
    first = values.reorder_measurements(events(spark), meta.where("code <> 'HR'"), ["ADMISSION.*", "TEMP"])
    assert [r["code"] for r in in_order(first, 239684)][3:6] == ["HR", "ADMISSION//CARDIAC", "TEMP"]


def test_extract_with_match_revise(spark):
    rows = [(1, "BP", None, "120/80", 0), (1, "HR", 80.0, None, 1), (1, "TEMP", None, "100F", 2), (1, None, 1.0, None, 3)]
    df = spark.createDataFrame(rows, "subject_id long, code string, numeric_value float, text_value string, __ord long").withColumn("time", F.lit(None).cast("timestamp"))
    part = lambda r: {"extract": {"from": "text_value", "regex": r}}
    blocks = [
        {"_matcher": {"code": "BP"}, "numeric_value": part(r"(\d+)/.*"), "code": "{code}//SYSTOLIC", "text_value": {"literal": None}},
        {"_matcher": {"code": "BP"}, "numeric_value": part(r".*/(\d+)"), "code": "{code}//DIASTOLIC", "text_value": {"literal": None}},
        {"_matcher": {"code": "TEMP", "text_value": {"regex": r"^[\d\.]+F$"}}, "numeric_value": part(r"^([\d\.]+)F$"), "code": "{code}//F", "text_value": {"literal": None}},
    ]
    got = in_order(match_revise(df, blocks, values.extract_values, mode="multi_match_and_revise"), 1)
    assert [(r["code"], r["numeric_value"]) for r in got] == [("BP//SYSTOLIC", 120.0), ("BP//DIASTOLIC", 80.0), ("TEMP//F", 100.0), ("HR", 80.0)]
    alone = in_order(match_revise(df, blocks, values.extract_values, mode="multi_match_and_revise", columns=values.extracted), 1)
    assert alone == got
    one = in_order(match_revise(df, blocks, values.extract_values, columns=values.extracted), 1)
    assert [r["code"] for r in one] == ["BP//SYSTOLIC", "TEMP//F", "HR"]
    with pytest.raises(ValueError, match="matcher of block 0"):
        match_revise(df, [{"_matcher": {"nope": 1}}], values.extract_values)
    with pytest.raises(ValueError, match="mode"):
        match_revise(df, blocks, values.extract_values, mode="foobar")
    with pytest.raises(ValueError, match="Missing columns"):
        values.extract_values(df, {"x": "{nope}"})


def test_expressions(spark):
    df = spark.createDataFrame([("a1", None, 3), ("b", "q", 4)], "foo string, bar string, baz int")

    def run(e):
        c, need = dsl.expression(e)
        return [r[0] for r in df.select(c).collect()], need

    assert run("foo") == (["a1", "b"], {"foo"})
    assert run("{foo}//{bar}") == ([None, "b//q"], {"foo", "bar"})
    assert run(["bar", {"literal": "x"}])[0] == ["x", "q"]
    assert run({"extract": {"from": "foo", "regex": r"a(\d)"}})[0] == ["1", None]
    assert run({"output": {"literal": 1}, "matcher": {"baz": 3}})[0] == [1, None]
    assert run({"foo": {"baz": {"present": True}}})[0] == ["a1", "b"]
    assert run({"literal": [1, 2]})[0] == [[1, 2], [1, 2]]
    for bad in (3, [], {"a": 1, "b": 2}, {"col": 4}, {"extract": {"from": "foo"}}, {"what": 3}):
        with pytest.raises(ValueError):
            dsl.expression(bad)
    for bad in (3, {1: 2}, {"a": {"regex": "x", "present": True}}, {"a": {"present": "yes"}}, {"a": {"like": "x"}}):
        with pytest.raises(ValueError):
            dsl.matcher(bad)


def test_shards(spark):
    ids = spark.range(100).select(F.col("id").alias("subject_id"))
    got = shards.shard_subjects(ids, fracs={"train": 0.8, "tuning": 0.1, "held_out": 0.1}, n_subjects_per_shard=30).collect()
    assert len({r["subject_id"] for r in got}) == len(got) == 100
    sizes = {}
    for r in got:
        sizes[r["split"], r["shard"]] = sizes.get((r["split"], r["shard"]), 0) + 1
    assert sorted(sizes.values()) == [10, 10, 26, 27, 27]
    given = spark.createDataFrame([(i, "custom") for i in range(100)], "subject_id long, split string")
    assert {r["split"] for r in shards.shard_subjects(ids, given).collect()} == {"custom"}
    assert shards.split_sizes(10, {"a": 0.99, "b": 0.01}) == {"a": 9, "b": 1}
    assert shards.split_sizes(101, {"a": 0.5, "b": None, "c": 0.25, "d": 0.25}) == {"a": 51, "c": 25, "d": 25}
    assert shards.split_sizes(3, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}) == {"a": 1, "b": 1, "c": 1}
    for n, fracs, why in ((10, {"a": 0.5}, "sum"), (1, {"a": 0.5, "b": 0.5}, "fill")):
        with pytest.raises(ValueError, match=why):
            shards.split_sizes(n, fracs)
    by_default = {r["split"] for r in shards.shard_subjects(ids).collect()}
    assert by_default == {"train", "tuning", "held_out"}


def test_wide_to_events(spark):
    df = spark.createDataFrame([(1, "5", "brown"), (2, None, "7.5")], "subject_id int, height string, eye string")
    got = sorted((r["subject_id"], r["code"], r["numeric_value"]) for r in wide_to_events(df).collect())
    assert got == [(1, "eye", None), (1, "height", 5.0), (2, "eye", 7.5), (2, "height", None)]


@pytest.mark.parametrize("name", ["age_years", "age_days", "ages_in_units"])
def test_ages_before_birth_are_those_of_the_sql(spark, tmp_path, name):
    """Births long after, just after and at the events, in customers' keys of larger tables, and a customer unknown."""
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    keys = [7, 15340, 16500, 16501, 17000, 24900, 89_999, 900_000]
    day = lambda k: datetime(1950, 1, 1) + timedelta(days=k)
    at = [day(16500), day(16500) + timedelta(hours=3), day(16501), day(16502), day(17000), datetime(1999, 7, 3)]
    spark.createDataFrame([(k, "A", 1.5) for k in keys[1:]], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(i, k, t, 2.0, "1-URGENT") for i, (k, t) in enumerate((k, t) for k in keys for t in at)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    items = [(i, t + timedelta(days=30), 3.0, "R", "F") for i, _, t, *_ in orders]
    spark.createDataFrame(items, "l_orderkey long, l_shipdate timestamp, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in ("customer", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(f"SELECT subject_id, epoch_us(time), code, numeric_value FROM ({entry.oracle_sql()[name]})").fetchall()
    got = entry.queries()[name](spark, str(tmp_path)).select("subject_id", F.unix_micros("time"), "code", "numeric_value").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))  # zeros with their signs
    assert any(v < 0 for *_, v in want) and any(v == 0 for *_, v in want)
