import json
import math

import pytest
import yaml
from base_data import SPLITS, events, in_order, parsed, splits
from pyspark.sql import functions as F

from eventspark import queries as catalogue
from eventspark.__main__ import main
from eventspark.plans.pipeline import Pipeline, load_config, parse_stages, set_override
from eventspark.plans.registry import builtin
from eventspark.sources import tables
from eventspark.streaming.events import apply_stateless, read_stream, windowed_counts, write_stream

STAGES = [
    {"filter_subjects": {"min_events_per_subject": 5}},
    {"add_time_derived_measurements": {"age": {"DOB_code": "MEDS_BIRTH", "age_code": "AGE", "age_unit": "years"}}},
    {"fit_outlier_detection": {"_base_stage": "aggregate_code_metadata", "aggregations": ["values/n_occurrences", "values/sum", "values/sum_sqd"]}},
    {"occlude_outliers": {"stddev_cutoff": 1}},
    {"fit_normalization": {"_base_stage": "aggregate_code_metadata", "aggregations": ["code/n_occurrences", "code/n_subjects", "values/n_occurrences", "values/sum", "values/sum_sqd"]}},
    "fit_vocabulary_indices",
    "normalization",
]


def test_seven_stage_pipeline(spark):
    rows, meta = Pipeline(parse_stages(STAGES)).apply(events(spark), None, splits(spark))
    vocab = {r["code"]: r["code/vocab_index"] for r in meta.collect()}
    assert [vocab[c] for c in ("ADMISSION//CARDIAC", "AGE", "DISCHARGE", "HR", "TEMP", "TIME_OF_DAY//[18,24)")] == [1, 2, 3, 7, 9, 12]
    got = in_order(rows, 1195293)
    hr = [r["numeric_value"] for r in got if r["code"] == 7]
    assert hr == [pytest.approx(x, abs=1e-2) if x is not None else None for x in (-0.758250, 1.203311, None, 0.587920, -1.258257, -1.335180)]
    temp = [r["numeric_value"] for r in got if r["code"] == 9]
    assert temp == [pytest.approx(x, abs=2e-2) for x in (-0.090013, -0.090013, -0.629886, -1.169760, -0.090013, 2.069521)]
    assert {r["subject_id"] for r in rows.collect()} == {239684, 1195293, 1500733}
    codes = [r["code"] for r in got]
    assert codes[:5] == [4, 6, 10, 8, 12]


def test_float32_statistics_go_negative(spark):
    rows, _ = Pipeline(parse_stages(STAGES), float32=True).apply(events(spark), None, splits(spark))
    ages = [r["numeric_value"] for r in in_order(rows, 1195293) if r["code"] == 2]
    assert all(x is None or math.isnan(x) or abs(x) < 1e3 for x in ages)


def test_config(tmp_path):
    with pytest.raises(ValueError, match="unique"):
        parse_stages(["a", "a"])
    with pytest.raises(TypeError):
        parse_stages("a")
    cfg = {"stages": ["normalization", {"occlude_outliers": {"stddev_cutoff": 1}}]}
    set_override(cfg, "stages.occlude_outliers.stddev_cutoff=3")
    set_override(cfg, "stages.normalization.x=1")
    set_override(cfg, "output_dir=/o")
    assert cfg == {"stages": [{"normalization": {"x": 1}}, {"occlude_outliers": {"stddev_cutoff": 3}}], "output_dir": "/o"}
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(cfg))
    assert load_config(tmp_path / "p.yaml", ["seed=2"])["seed"] == 2
    assert load_config("__null__") == {}
    with pytest.raises(KeyError, match="nope"):
        Pipeline.from_config({"stages": ["nope"]})


def test_registry():
    r = builtin()
    assert {k for k, s in r.items() if s.is_metadata} == {"aggregate_code_metadata", "fit_vocabulary_indices"}
    with pytest.raises(ValueError, match="twice"):
        r.add(lambda df: df, name="normalization")

    @r.register(name="mine")
    def mine(df, n=2):
        return (df, n)

    assert r["mine"].bind({"n": 5}, {"df": "d", "spark": None}) == ("d", 5)
    with pytest.raises(ValueError, match="no setting"):
        r["mine"].bind({"m": 5}, {"df": "d"})


def test_functors_and_identity():
    r = builtin()
    r.add(lambda n: (lambda df: (df, n)), name="functor")
    r.add(lambda n=None: None, name="nothing")
    r.add(None, name="as_is")
    assert r["functor"].bind({"n": 3}, {"df": "rows"}) == ("rows", 3)
    assert r["nothing"].bind({}, {"df": "rows"}) == r["as_is"].bind({}, {"df": "rows"}) == "rows"


def test_one_stage_from_the_command_line(spark, tmp_path):
    events(spark, False).write.parquet(str(tmp_path / "in/data/0"))
    assert main(["stage", "drop_regex", "regex=^T", f"input_dir={tmp_path}/in", f"output_dir={tmp_path}/out"]) == 0
    assert spark.read.parquet(str(tmp_path / "out/data")).where("code = 'TEMP'").count() == 0


def test_own_source_and_sink(spark, tmp_path):
    got = []
    Pipeline(parse_stages([{"drop_regex": {"regex": "^T"}}])).run(spark, "x", str(tmp_path), read=lambda s, p: events(s, False), write=lambda df, p: got.append(df.count()))
    assert got == [46]  # 62 rows, 16 of them TEMP


def test_match_revise_on_fit_is_refused(spark):
    p = Pipeline(parse_stages([{"aggregate_code_metadata": {"_match_revise": [{"_matcher": {}}]}}]))
    with pytest.raises(ValueError, match="map stages only"):
        p.apply(events(spark), None, splits(spark))


def test_fits_see_train_subjects_only(spark, tmp_path):
    root, df = tmp_path / "in", events(spark, False)
    fit = [{"aggregate_code_metadata": {"aggregations": ["code/n_subjects"]}}]
    with pytest.raises(FileNotFoundError, match="train"):
        Pipeline(parse_stages(fit)).apply(df)
    every = Pipeline(parse_stages([{"aggregate_code_metadata": {"aggregations": ["code/n_subjects"], "train_only": False}}])).apply(df)[1]
    assert {r["code"]: r["code/n_subjects"] for r in every.collect()}["HR"] == 6
    with pytest.raises(ValueError, match="only a fit"):
        Pipeline(parse_stages([{"drop_regex": {"regex": "x", "train_only": True}}])).apply(df)
    of = {i: s for i, s in SPLITS}
    for s in set(of.values()):
        df.where(F.col("subject_id").isin([i for i in of if of[i] == s])).coalesce(1).write.parquet(str(root / f"data/{s}/0"))
    Pipeline(parse_stages([{"filter_subjects": {"min_events_per_subject": 5}}, *fit])).run(spark, str(root), str(tmp_path / "out"))
    got = {r["code"]: r["code/n_subjects"] for r in spark.read.parquet(str(tmp_path / "out/metadata/codes")).collect()}
    assert got["HR"] == 2
    assert {r["subject_id"] for r in spark.read.parquet(str(tmp_path / "out/data")).collect()} == {239684, 1195293, 1500733}


def test_a_rerun_with_other_settings_makes_anew(spark, tmp_path):
    root = tmp_path / "in"
    events(spark, False).coalesce(1).write.parquet(str(root / "data/0"))
    splits(spark).write.parquet(str(root / "metadata/subject_splits.parquet"))
    fit = lambda name: parse_stages([{"aggregate_code_metadata": {"aggregations": [name]}}])
    for name in ("code/n_subjects", "code/n_occurrences"):
        Pipeline(fit(name)).run(spark, str(root), str(tmp_path / "out"))
        assert spark.read.parquet(str(tmp_path / "out/metadata/codes")).columns == ["code", name]
    before = sorted(f.name for f in (tmp_path / "out/data").iterdir())
    Pipeline(fit("code/n_occurrences")).run(spark, str(root), str(tmp_path / "out"))
    assert sorted(f.name for f in (tmp_path / "out/data").iterdir()) == before
    events(spark, False).where("code <> 'HR'").coalesce(1).write.parquet(str(root / "data/1"))
    Pipeline(fit("code/n_occurrences")).run(spark, str(root), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/data")).count() > 62


def test_own_fit(spark):
    r = builtin()
    r.add(lambda df, by="code": df.groupBy(by).agg(F.max("numeric_value").alias("top")), name="top", reduce=lambda parts, least=0: parts.where(F.col("top") > least), needs=("code", "top"))
    run = lambda **cfg: Pipeline(parse_stages([{"top": cfg}]), r).apply(events(spark), None, splits(spark))[1]
    train = {i for i, s in SPLITS if s == "train"}
    assert {x["code"] for x in run(least=150).collect()} == {c for i, _, c, v in parsed() if i in train and (v or 0) > 150}
    with pytest.raises(ValueError, match="lack"):
        run(by="subject_id")
    with pytest.raises(ValueError, match="no setting"):
        run(most=3)
    with pytest.raises(ValueError, match="is a fit"):
        r.add(None, name="x", kind="map", reduce=lambda parts: parts)


def test_stage_with_a_folder_and_its_own_sink(spark, tmp_path):
    folder, seen = tmp_path / "drop_some", []
    folder.mkdir()
    (folder / "config.yaml").write_text("regex: ^T\n")
    r = builtin()
    r.add_folder(folder, r["drop_regex"].fn, write=lambda df, at: seen.append((at, df.count())))
    assert Pipeline(parse_stages(["drop_some"]), r).apply(events(spark))[0].count() == 46
    Pipeline(parse_stages(["drop_some"]), r).run(spark, "x", str(tmp_path / "out"), read=lambda s, p: events(s))
    assert seen == [(f"{tmp_path}/out/stages/00-drop_some", 46)]


def test_shards_by_name(spark, tmp_path):
    for name in ("train/0", "train/1", "tuning/0", "x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{name}.parquet").touch()
    got = tables.shard_files(spark, str(tmp_path), "/out", out_suffix=".csv")
    assert list(got) == ["train/0", "train/1", "tuning/0", "x"]
    assert got["x"] == (f"{tmp_path}/x.parquet", "/out/x.csv")
    assert list(tables.shard_files(spark, str(tmp_path), "/out", train_only=True)) == ["train/0", "train/1"]
    assert list(tables.shard_files(spark, str(tmp_path), "/out", prefix="tun")) == ["tuning/0"]
    with pytest.raises(FileNotFoundError):
        tables.shard_files(spark, str(tmp_path), "/out", prefix="nope")
    with pytest.raises(ValueError, match="more than once"):
        tables.read_events(spark, ["a", "a"])


def test_wide_csv_source(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text("subject_id,height,eyes\n1,170.5,brown\n2,,blue\n")
    (raw / "b.csv").write_text("subject_id,weight\n1,60\n")
    (raw / "c.csv").write_text("other\n1\n")
    Pipeline(parse_stages([{"wide_csv_to_events": {"path": str(raw)}}])).run(spark, "unused", str(tmp_path / "out"))
    got = sorted((r["subject_id"], r["code"], r["numeric_value"]) for r in spark.read.parquet(str(tmp_path / "out/data")).collect())
    assert got == [(1, "eyes", None), (1, "height", 170.5), (1, "weight", 60.0), (2, "eyes", None), (2, "height", None)]
    meta = spark.read.parquet(str(tmp_path / "out/metadata/codes"))
    assert meta.columns == ["code", "description", "parent_codes"]
    assert [r["code"] for r in meta.collect()] == ["eyes", "height", "weight"]
    with pytest.raises(FileNotFoundError):
        tables.wide_csv_to_events(spark, str(tmp_path / "nothing"))


def test_command_line_run_and_rerun(spark, tmp_path):
    root = tmp_path / "in"
    df = events(spark, False)
    df.where("subject_id > 100000").coalesce(1).write.parquet(str(root / "data/train/0"))
    df.where("subject_id <= 100000").coalesce(1).write.parquet(str(root / "data/train/1"))
    splits(spark).write.parquet(str(root / "metadata/subject_splits.parquet"))
    cfg = {"input_dir": str(root), "output_dir": str(tmp_path / "out"), "stages": [*STAGES[:1], {"reshard_to_split": {"n_subjects_per_shard": 2}}]}
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(cfg))
    assert main(["run", str(tmp_path / "p.yaml")]) == 0
    out = spark.read.parquet(str(tmp_path / "out/data"))
    assert {r["subject_id"] for r in out.collect()} == {239684, 1195293, 1500733}
    files = sorted((tmp_path / "out/data").rglob("*.parquet"))
    stamp = [f.stat().st_mtime_ns for f in files]
    assert main(["run", str(tmp_path / "p.yaml")]) == 0
    assert [f.stat().st_mtime_ns for f in files] == stamp
    assert main(["stages"]) == 0


def test_run_with_fits_writes_metadata(spark, tmp_path):
    root = tmp_path / "in"
    events(spark, False).coalesce(1).write.parquet(str(root / "data/0"))
    splits(spark).write.parquet(str(root / "metadata/subject_splits.parquet"))
    Pipeline(parse_stages(STAGES)).run(spark, str(root), str(tmp_path / "out"), keep_intermediates=True)
    assert spark.read.parquet(str(tmp_path / "out/metadata/codes")).count() == 12
    got = [r["code"] for r in spark.read.parquet(str(tmp_path / "out/data")).where("subject_id = 239684").collect()]
    assert got[:5] == [5, 6, 10, 8, 11]


def test_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_events(spark, str(tmp_path))
    m = spark.createDataFrame([(1, "train", 0), (2, "train", 1)], "subject_id long, split string, shard int")
    text = tables.shard_map_json(m)
    assert json.loads(text) == {"train/0": [1], "train/1": [2]}
    assert sorted(map(tuple, tables.read_shard_map(spark, text).collect())) == [(1, "train", 0), (2, "train", 1)]
    (tmp_path / "w.csv").write_text("subject_id,height\n1,5.5\n2,\n")
    assert sorted((r["subject_id"], r["numeric_value"]) for r in tables.read_wide_csv(spark, str(tmp_path / "w.csv")).collect()) == [(1, 5.5), (2, None)]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    events(spark, False).write.parquet(src)
    stream = read_stream(spark, src, events(spark, False).schema)
    p = Pipeline(parse_stages([{"drop_regex": {"regex": "^T"}}]))
    write_stream(apply_stateless(stream, p), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("code = 'TEMP'").count() == 0
    with pytest.raises(ValueError, match="don't run on a stream"):
        apply_stateless(stream, Pipeline(parse_stages(["filter_subjects"])))
    assert windowed_counts(stream).isStreaming


@pytest.mark.parametrize("name", ["normalize", "filter_subjects_events", "timeline_delta", "bin_quantiles", "match_revise"])
def test_plans_have_no_python_and_no_cross_product(spark, name):
    plan = catalogue.Q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_inputs_are_read_once(spark):
    for name in ("filter_subjects_events", "filter_subjects_measurements", "match_revise", "multi_match_revise", "add_new_events"):
        df = catalogue.Q[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 5, name  # the view over three tables scans two of them twice
        assert plan.count("Exchange hashpartitioning") <= 3, name


def test_subjects_are_dealt_once(spark):
    df = events(spark, False).repartition("subject_id")
    out = Pipeline(parse_stages([{"filter_subjects": {"min_events_per_subject": 2}}, {"add_time_derived_measurements": {"age": None, "timeline_tokens": {"time_unit": "d"}}}])).apply(df)[0]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastNestedLoop" not in plan


def test_catalogue_has_sql_for_every_query():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_queries_agree_with_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("customer", "orders", "lineitem", "events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")

    def text(v):
        return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)

    for name in ("agg_quantiles", "agg_summary_row", "filter_subjects_events", "timeline_delta", "normalize", "bin_quantiles", "multi_match_revise", "match_revise", "order_at_sink", "order_of_time_derived_rows", "order_of_reordered_rows", "scan_filtered", "expr_literal", "agg_quantiles_with_summary", "bin_with_modifiers", "reshard_rows", "own_map_reduce", "add_new_events", "vocab_modifiers", "flagship_pipeline", "bins_in_blocks", "tokens_in_blocks", "filter_subjects_in_blocks"):
        df = catalogue.Q[name](spark, "/root/testdata/sf0.001")
        cols = sorted(df.columns)
        want = con.execute(catalogue.SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == cols
        theirs = sorted(tuple(text(dict(zip(names, r, strict=True))[c]) for c in cols) for r in want.fetchall())
        assert sorted(tuple(text(r[c]) for c in cols) for r in df.select(*[F.col(f"`{c}`") for c in cols]).collect()) == theirs, name
