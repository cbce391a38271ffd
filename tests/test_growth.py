"""Statistics kept by file, tables by subject, ranks in ranges, carried order, streams and CSV sources."""

import math
import random

import pytest
from base_data import SPLITS, events, splits
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventspark.functions.numbering import ordered
from eventspark.operators import codes, filters, timeline
from eventspark.operators.incremental import CodeStatistics
from eventspark.plans.pipeline import Pipeline, parse_stages
from eventspark.sources import layout, tables

EVERY = [*codes.AGGREGATES, {"name": "values/quantiles", "quantiles": [0.1, 0.5]}]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def alike(a, b):
    if isinstance(a, tuple):
        return len(a) == len(b) and all(map(alike, a, b))
    return math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def records_read(spark):
    """Input records of all stages of the session so far."""
    none, jvm = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


# -- incremental statistics ------------------------------------------------------------------------------------


def many_events(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["A", "B//x", "C", None]), rng.choice([None, float("nan"), 1.0, 2.5, -3.0, rng.gauss(0, 100)]), rng.choice(["u", None])) for _ in range(n)]
    return spark.createDataFrame(rows, "subject_id long, code string, numeric_value float, unit string")


@pytest.mark.parametrize("modifiers", [None, ["unit"]])
def test_statistics_kept_by_file_equal_a_full_fit(spark, tmp_path, modifiers):
    df, data = many_events(spark), str(tmp_path / "data")
    kept = CodeStatistics(spark, str(tmp_path / "kept"), modifiers)
    with pytest.raises(FileNotFoundError):
        kept.metadata(EVERY)

    def same():
        every = spark.read.option("recursiveFileLookup", "true").parquet(data)
        want = rows_of(codes.aggregate_code_metadata(every, EVERY, True, modifiers))
        got = kept.metadata(EVERY, True)
        assert got.columns == ["code", *(modifiers or []), *codes.AGGREGATES, "values/quantiles"]
        return alike(tuple(rows_of(got)), tuple(want))

    for i in range(3):
        df.where(f"pmod(hash(*), 4) = {i}").coalesce(1).write.parquet(f"{data}/a b%{i}")
    first = kept.refresh(data)
    assert (len(first.read), first.dropped, first.kept) == (3, [], 0)
    assert same()
    df.where("pmod(hash(*), 4) = 3").coalesce(1).write.parquet(f"{data}/new")
    before, n = records_read(spark), spark.read.parquet(f"{data}/new").count()
    added = kept.refresh(data)
    read = records_read(spark) - before
    assert (len(added.read), added.kept) == (1, 3)
    assert read < 5 * n  # two scans of the new file, its own partial results, the list of files; not the other 3 n rows twice
    assert same()
    df.where("code = 'A'").coalesce(1).write.mode("overwrite").parquet(f"{data}/a b%1")
    changed = kept.refresh(data)
    assert (len(changed.read), len(changed.dropped), changed.kept) == (1, 1, 3)
    assert same()
    kept.compact()
    assert same()
    assert kept.refresh(data).read == []
    assert len(tables.folders(spark, str(tmp_path / "kept/batches"))) == 1


def test_statistics_of_an_unfinished_refresh_do_not_count(spark, tmp_path, monkeypatch):
    data = str(tmp_path / "data")
    events(spark, False).coalesce(1).write.parquet(f"{data}/0")
    kept = CodeStatistics(spark, str(tmp_path / "kept"))
    kept.refresh(data)
    before = rows_of(kept.metadata(["code/n_occurrences"]))
    events(spark, False).coalesce(1).write.parquet(f"{data}/1")
    with monkeypatch.context() as m:
        m.setattr(CodeStatistics, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            kept.refresh(data)
    assert rows_of(kept.metadata(["code/n_occurrences"])) == before
    assert len(kept.refresh(data).read) == 1
    assert {c: 2 * n for c, n in before} == dict(rows_of(kept.metadata(["code/n_occurrences"])))


def test_incremental_fit_in_a_pipeline(spark, tmp_path):
    """Train subjects only; other splits make every file be read again; rows that a stage changed are refused."""
    root, out = tmp_path / "in", str(tmp_path / "out")
    df = events(spark, False)
    df.where("subject_id > 800000").coalesce(1).write.parquet(str(root / "data/0"))
    splits(spark).write.parquet(str(root / "metadata/subject_splits.parquet"))
    fit = {"aggregate_code_metadata": {"aggregations": ["code/n_subjects", "values/sum"], "incremental": True}}
    Pipeline(parse_stages([fit])).run(spark, str(root), out)
    df.where("subject_id <= 800000").coalesce(1).write.parquet(str(root / "data/1"))
    Pipeline(parse_stages([fit])).run(spark, str(root), out)
    kept = CodeStatistics(spark, f"{out}/statistics/aggregate_code_metadata").files()
    assert kept.count() == 2
    assert kept.select("batch").distinct().count() == 2
    want = codes.aggregate_code_metadata(tables.of_split(df, splits(spark)), ["code/n_subjects", "values/sum"])
    assert alike(tuple(rows_of(spark.read.parquet(f"{out}/metadata/codes"))), tuple(rows_of(want)))
    assert len({i for i, s in SPLITS if s == "train"}) < len(SPLITS)
    splits(spark).where("subject_id <> 68729").write.mode("overwrite").parquet(str(root / "metadata/subject_splits.parquet"))
    Pipeline(parse_stages([fit])).run(spark, str(root), out, overwrite=True)
    assert CodeStatistics(spark, f"{out}/statistics/aggregate_code_metadata").files().select("batch").distinct().count() == 1
    with pytest.raises(ValueError, match="incremental"):
        Pipeline(parse_stages([{"drop_regex": {"regex": "^HR"}}, fit])).run(spark, str(root), str(tmp_path / "other"))


def test_no_expand_in_distinct_counts(spark):
    df = many_events(spark, 200)
    for total in (False, True):
        assert "Expand" not in plan_of(codes.aggregate_code_metadata(df, list(codes.AGGREGATES), total))


def test_input_is_read_as_often_whatever_the_number_of_fits(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    events(spark, False).coalesce(1).write.parquet(str(root / "data/0"))
    splits(spark).write.parquet(str(root / "metadata/subject_splits.parquet"))
    seen, fit = [], codes.aggregate_code_metadata
    stages = [{"filter_subjects": {"min_events_per_subject": 2}}]
    for i in range(4):
        stages += [{f"fit{i}": {"_base_stage": "aggregate_code_metadata", "aggregations": ["values/n_occurrences", "values/sum", "values/sum_sqd"]}}, {f"occlude{i}": {"_base_stage": "occlude_outliers", "stddev_cutoff": 3}}]
    p = Pipeline(parse_stages(stages))
    p.registry["aggregate_code_metadata"].fn = lambda df, aggregations: (seen.append(df), fit(df, aggregations))[1]
    p.run(spark, str(root), str(tmp_path / "out"))
    from_input = [sum("/in/data/" in f for f in df.inputFiles()) for df in seen]
    assert from_input[0] > 0
    assert from_input[1:] == [0, 0, 0]
    lazily = Pipeline(parse_stages(stages)).apply(tables.read_events(spark, str(root / "data")), None, splits(spark))[0]
    assert alike(tuple(rows_of(spark.read.parquet(str(tmp_path / "out/data")))), tuple(rows_of(lazily)))


# -- tables by subject -----------------------------------------------------------------------------------------


def test_stages_by_subject_exchange_nothing(spark, tmp_path):
    """Filters, tokens, a join and a merge over tables by subject: the rows of plain Parquet, without an exchange."""
    df = tables.read_events(spark, _written(spark, tmp_path), keep_order=True)
    path = str(tmp_path / "by")
    layout.write_by_subject(df, path, 4)
    again = str(tmp_path / "again")
    layout.write_by_subject(df.where("code = 'HR'"), again, 4)
    tokens = {"time_of_day": timeline.DEFAULTS["time_of_day"], "timeline_tokens": {"time_unit": "days"}}
    with_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, two = layout.read_by_subject(spark, path), layout.read_by_subject(spark, again)
        both, hr = layout.read_by_subject(spark, path, again), df.where("code = 'HR'")
        count = lambda d: d.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
        for got, want in (
            (filters.filter_subjects(one, 2, 5), filters.filter_subjects(df, 2, 5)),
            (timeline.add_time_derived_measurements(one, tokens), timeline.add_time_derived_measurements(df, tokens)),
            (one.join(two.select("subject_id").distinct(), "subject_id", "left_semi"), df.join(hr.select("subject_id").distinct(), "subject_id", "left_semi")),
            (count(both), count(df.unionByName(hr))),
            (layout.sorted_in_place(timeline.add_time_derived_measurements(both, tokens)), timeline.add_time_derived_measurements(df.unionByName(hr), tokens)),
        ):
            assert "Exchange" not in plan_of(got)
            assert "Exchange" in plan_of(want)
            assert rows_of(got.select(*want.columns)) == rows_of(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_limit)
    assert rows_of(both.select(*df.columns)) == rows_of(df.unionByName(hr))
    layout.write_by_subject(df, str(tmp_path / "other"), 3)
    with pytest.raises(ValueError, match="one number"):
        layout.read_by_subject(spark, path, str(tmp_path / "other"))
    with pytest.raises(FileNotFoundError):
        layout.read_by_subject(spark, str(tmp_path / "nowhere"))


def _written(spark, tmp_path):
    df = events(spark, False)
    for i in range(3):
        df.where(f"pmod(subject_id, 3) = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return str(tmp_path / "in")


# -- order -----------------------------------------------------------------------------------------------------


def test_carried_order_is_one_long_per_row(spark, tmp_path, monkeypatch):
    df = tables.read_events(spark, _written(spark, tmp_path), keep_order=True)
    assert dict(df.dtypes)[tables.ORDER] == "bigint"
    own = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    want = own.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("o")).orderBy("o").drop("o").collect()
    assert df.orderBy(tables.ORDER).drop(tables.ORDER).collect() == tables.utc(spark.createDataFrame(want, own.schema)).collect()
    long = tables.with_order(own, [str(tmp_path / "in")], most=1)
    assert long.orderBy(tables.ORDER).drop(tables.ORDER).collect() == want


def test_ordered_numbers_have_no_gap_and_spread_over_tasks(spark):
    """One prefix for all keys, many equal ones, nulls."""
    df = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.concat(F.lit("DIAGNOSIS//ICD10//"), F.lpad((F.col("id") * 7919 % 5000).cast("string"), 6, "0"))).alias("code"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordered(df.repartition(8), [F.col("code").asc_nulls_first()], "at")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [r["code"] for r in sorted(out.collect(), key=lambda r: r["at"])]
    assert got == sorted((r["code"] for r in df.collect()), key=lambda c: (c is not None, c or ""))
    assert sorted(r["at"] for r in out.collect()) == list(range(20_000))
    assert max(sizes) < 10_000
    assert ordered(df.limit(0), [F.col("code")], "at").collect() == []


def test_vocabulary_of_one_prefix(spark):
    meta = spark.range(30_000).select(F.concat(F.lit("DIAGNOSIS//"), (F.col("id") * 7919 % 30_011).cast("string")).alias("code"))
    got = codes.fit_vocabulary_indices(meta)
    want = meta.withColumn("code/vocab_index", F.row_number().over(Window.orderBy("code")))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    with pytest.raises(ValueError, match=r"unique.*DIAGNOSIS//7"):
        codes.fit_vocabulary_indices(meta.limit(50).unionByName(spark.createDataFrame([("DIAGNOSIS//7",)] * 3, "code string")))


# -- shards ----------------------------------------------------------------------------------------------------


def test_resharded_rows_are_written_as_they_are(spark, tmp_path, monkeypatch):
    """Split and shard are columns of the rows, so the sink neither drops them nor joins them again."""
    df = events(spark, False).withColumns({"split": F.when(F.col("subject_id") % 2 == 0, "train").otherwise("tuning"), "shard": (F.col("subject_id") % 3).cast("int")})
    tables.write_events(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(back.select(*df.columns)) == rows_of(df)
    assert len(list((tmp_path / "out").glob("split=*/shard=*/*.parquet"))) == df.select("split", "shard").distinct().count()


# -- streams ---------------------------------------------------------------------------------------------------

TOKENS = {"age": timeline.DEFAULTS["age"], "time_of_day": timeline.DEFAULTS["time_of_day"], "timeline_tokens": {"time_unit": "hours"}}


def stream_rows(seed=3):
    """Micro-batches of (subject, second, code), rows up to an hour behind the latest; a last row, of a subject of its
    own, moves the watermark past all others."""
    rng = random.Random(seed)
    batches, now = [], 1_000_000_000
    rows = [(s, now + s, "MEDS_BIRTH") for s in range(6)]
    for _ in range(5):
        batches.append(rows)
        now += 7200
        rows = [(rng.randrange(6), now - rng.randrange(3500), rng.choice(["A", "B"])) for _ in range(12)] + [(1, now, "A"), (None, now, "A")]
    return [*batches, rows, [(99, now + 10_000_000, "A")], [(99, now + 10_000_001, "A")]]


def test_time_derived_rows_on_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Late rows, several micro-batches, and a restart from the checkpoint after each of them."""
    from eventspark.streaming.events import read_stream, write_stream
    from eventspark.streaming.timeline import time_derived_stream

    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "subject_id long, second long, code string"
    every = []
    for rows in stream_rows():
        df = spark.createDataFrame(rows, schema).select("subject_id", F.timestamp_seconds("second").alias("time"), "code", F.lit(1.0).cast("float").alias("numeric_value"))
        df.coalesce(1).write.mode("append").parquet(src)
        every += rows
        write_stream(time_derived_stream(read_stream(spark, src, df.schema), TOKENS, late="1 hour", end_after="30 days"), out, state).awaitTermination()
    whole = spark.createDataFrame([r for r in every if r[0] not in (None, 99)], schema).select("subject_id", F.timestamp_seconds("second").alias("time"), "code", F.lit(1.0).cast("float").alias("numeric_value"))
    added = timeline.add_time_derived_measurements(whole, TOKENS).where("code NOT IN ('A', 'B', 'MEDS_BIRTH')")
    got, want = ([(r["subject_id"], r["time"], r["code"], None if r["numeric_value"] is None else round(r["numeric_value"], 5)) for r in d.collect()] for d in (spark.read.parquet(out).where("subject_id <> 99"), added))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {c for _, _, c, _ in got} >= {"AGE", "TIMELINE//START", "TIMELINE//END", "TIMELINE//DELTA//hours"}


def test_stream_calls_and_keeps_a_bucket_not_a_subject(spark, tmp_path):
    """Kept rows and calls are those of buckets, whatever the number of subjects and events; rows are those of a batch."""
    from eventspark.streaming.events import read_stream, write_stream
    from eventspark.streaming.timeline import time_derived_stream

    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    df = spark.range(3000).selectExpr("id % 500 * 7 - 900 AS subject_id", "timestamp_seconds(1000000000 + id * 997) AS time", "'A' AS code", "CAST(NULL AS float) AS numeric_value")
    df.write.parquet(src)
    query = write_stream(time_derived_stream(read_stream(spark, src, df.schema), {"timeline_tokens": {"time_unit": "hours"}}, late="0 seconds", end_after="0 seconds", buckets=8), out, state)
    query.awaitTermination()
    done = [op for p in query.recentProgress for op in p["stateOperators"]]
    assert done[-1]["numRowsTotal"] == 8 and max(op["numRowsUpdated"] for op in done) <= 8
    want = timeline.timeline_tokens(df, {"time_unit": "hours"})
    got = spark.read.parquet(out)
    key = lambda r: (r["subject_id"], r["time"], r["code"], r["numeric_value"] and round(r["numeric_value"], 4))
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str)


def test_stream_refuses_unknown_features(spark):
    from eventspark.streaming.timeline import time_derived_stream

    stream = spark.readStream.format("rate").load().selectExpr("value AS subject_id", "timestamp AS time", "'A' AS code")
    with pytest.raises(Exception, match="Unknown"):
        time_derived_stream(stream, {"buzz": {}})
    with pytest.raises(ValueError, match="DOB"):
        time_derived_stream(stream, {"age": {"age_unit": "y"}})


# -- wide CSV files --------------------------------------------------------------------------------------------


def test_a_thousand_csv_files_are_one_job(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"{i:04}.csv").write_text(f"subject_id,a,{'b' if i % 2 else 'c'}\n{i},{i / 4},\n{i},x,7\n" if i % 10 else "other\n1\n")
    sc = spark.sparkContext
    sc.setJobGroup("csv", "csv")
    try:
        got = tables.wide_csv_to_events(spark, str(tmp_path)).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("csv")) == 1
    want = [(i, None, c, v) for i in range(1000) if i % 10 for c, v in (("a", i / 4), ("a", None), ("b" if i % 2 else "c", None), ("b" if i % 2 else "c", 7.0))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by_spark = tables._by_header(spark, str(tmp_path / "00[0-2]*.csv"), "subject_id")
    assert rows_of(tables.wide_csv_to_events(spark, str(tmp_path / "00[0-2]*.csv"))) == rows_of(by_spark)


def test_csv_cells_of_odd_files(spark, tmp_path):
    from eventspark.sources import wide_csv

    (tmp_path / "a.csv").write_text('id,"na,me",n\n1,"x ""y""",\n2,ü,"1e3"\n,z,-Infinity\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("id,n\n")
    (tmp_path / "not.txt").write_text("id,n\n9,9\n")
    (tmp_path / "long.csv").write_text("id,n\n" + "".join(f"{i},{i}\n" for i in range(20_000)))
    cells = wide_csv.read_cells(spark, str(tmp_path), "id", blockBytes=str(1 << 14))
    assert cells.where("code = 'na,me' OR id IS NULL").count() == 4
    assert {(r["id"], r["cell"]) for r in cells.where("code = 'na,me'").collect()} == {("1", 'x "y"'), ("2", "ü"), (None, "z")}
    assert tables.cells_to_events(cells).agg(F.sum("numeric_value")).first()[0] == -math.inf
    assert cells.where("cast(id as int) > 2").count() == 19_997
    assert [len(p.paths) for p in wide_csv.dealt([("a", 5, 0), ("b", 5, 0), ("c", 50, 0), ("d", 1, 0)], 10)] == [2, 1, 1]
    with pytest.raises(FileNotFoundError):
        tables.wide_csv_to_events(spark, str(tmp_path / "nothing"))


def test_csv_cells_on_a_stream(spark, tmp_path):
    """New files alone are read after a restart."""
    from eventspark.sources import wide_csv
    from eventspark.streaming.events import write_stream

    src, out, state = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    for i in range(3):
        (src / f"{i}.csv").write_text(f"subject_id,v\n{i},{i}\n")
        write_stream(tables.cells_to_events(wide_csv.stream_cells(spark, str(src), settle="0")), out, state).awaitTermination()
        assert sorted(r["subject_id"] for r in spark.read.parquet(out).collect()) == list(range(i + 1))


# -- sketches --------------------------------------------------------------------------------------------------


def test_sketches_are_near_and_only_if_asked_for(spark, tmp_path):
    """Counts within 5 %, quantiles within 3 % of the ranks, over rows at once and over merged files; nulls, no values."""
    df = spark.range(40_000).select((F.col("id") % 9_000).alias("subject_id"), F.when(F.col("id") % 4 == 0, "A").when(F.col("id") % 4 == 1, "none").otherwise("B").alias("code"), F.when(F.col("id") % 4 != 1, (F.col("id") * 7919 % 40_009).cast("float")).alias("numeric_value"))
    asked = ["code/n_occurrences", "approx/code/n_subjects", "approx/values/n_subjects", {"name": "approx/values/quantiles", "quantiles": [0.1, 0.5, 0.9]}]
    exact = {r["code"]: r for r in codes.aggregate_code_metadata(df, ["code/n_subjects", "values/n_subjects", "values/n_occurrences"], True).collect()}
    ranks = {c: sorted(r[0] for r in df.where(F.lit(True) if c is None else F.col("code") == c).where("numeric_value is not null").select("numeric_value").collect()) for c in exact}
    for i in range(3):
        df.where(f"pmod(subject_id, 3) = {i}").coalesce(1).write.parquet(str(tmp_path / f"data/{i}"))
    kept = CodeStatistics(spark, str(tmp_path / "kept"), kinds=("codes", "sketches"))
    kept.refresh(str(tmp_path / "data"))
    for got in (codes.aggregate_code_metadata(df, asked, True), kept.metadata(asked, True)):
        assert got.columns == ["code", "code/n_occurrences", "approx/code/n_subjects", "approx/values/n_subjects", "approx/values/quantiles"]
        rows = got.collect()
        assert len(rows) == 4
        for r in rows:
            for n in ("code/n_subjects", "values/n_subjects"):
                assert abs(r[f"approx/{n}"] - exact[r["code"]][n]) <= 0.05 * exact[r["code"]][n]
            own = ranks[r["code"]]
            assert (r["approx/values/quantiles"] is None) == (not own)
            for q in (0.1, 0.5, 0.9) if own else ():
                assert own[int((q - 0.03) * len(own))] <= r["approx/values/quantiles"][f"values/quantile/{q}"] <= own[int((q + 0.03) * len(own))]
    assert sorted(tables.folders(spark, f"{tmp_path}/kept/batches/{kept.files().first()['batch']}")) == ["codes", "sketches"]
    with pytest.raises(ValueError, match="keep"):
        kept.metadata(["code/n_subjects"])
    with pytest.raises(ValueError, match="Unknown"):
        CodeStatistics(spark, "x", kinds=("guesses",))
    assert not [c for c in codes.aggregate_code_metadata(df, list(codes.AGGREGATES)).columns if "approx" in c]


# -- tasks of a bounded number of rows -------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def most_rows(df, tables):
    """Rows of the largest partition after the query's last exchange by number, and those of the tables."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0], sum(df.sparkSession.read.parquet(f"{SF}/{t}.parquet").count() for t in tables)


def test_joined_items_are_dealt_by_rows(spark, monkeypatch):
    from eventspark import queries

    monkeypatch.setattr(queries, "_TASK_ROWS", 200, raising=False)
    most, rows = most_rows(queries._modified(spark, SF), ["orders", "lineitem"])
    assert rows > 200 * 30 and most < 1000


def made_by(spark, monkeypatch, name, kind):
    """The folder that a query wrote, with few rows to a task."""
    from glob import glob

    from eventspark import queries
    from eventspark.sources.scratch import scratch_root

    monkeypatch.setattr(queries, "_TASK_ROWS", 200, raising=False)
    at = f"{scratch_root(spark).removeprefix('file://')}/{kind}-*"
    before = set(glob(at))
    queries.queries()[name](spark, SF)
    return (set(glob(at)) - before).pop()


def test_shards_grow_in_number_not_in_rows(spark, monkeypatch):
    root = made_by(spark, monkeypatch, "train_shards_only", "shards")
    sizes = spark.read.parquet(f"{root}/all").groupBy("split", "shard").count()
    assert sizes.agg(F.max("count")).first()[0] < 1000


def test_buckets_grow_in_number_not_in_rows(spark, monkeypatch):
    root = made_by(spark, monkeypatch, "tokens_of_tables_by_subject", "by-subject")
    assert layout.buckets_of(spark, f"{root}/timed") > 30


def test_subjects_of_the_flagship_are_dealt_by_rows(spark, monkeypatch):
    from eventspark import queries

    monkeypatch.setattr(queries, "_TASK_ROWS", 200, raising=False)
    monkeypatch.setattr(queries, "FLAGSHIP", [{"filter_subjects": {"min_events_per_subject": 1}}])
    most, rows = most_rows(queries.flagship(spark, SF), ["customer", "orders", "lineitem"])
    assert rows > 200 * 30 and most < 1000
