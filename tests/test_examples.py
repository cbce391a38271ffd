"""Scenarios from files, stages of installed packages, and small parts of values and sources."""

import pytest
from base_data import events
from pyspark.sql import functions as F

from eventspark.operators import values
from eventspark.plans import examples
from eventspark.plans.pipeline import Pipeline
from eventspark.plans.registry import builtin, installed

IN = """
data/train/0.parquet: |-
  subject_id,time,code,numeric_value,note
  1,,EYES,,
  1,"01/02/2020, 10:00:00",HR,60,a
  1,"01/02/2020, 10:00:00",TEMP,36.5,
  2,2020-01-03 00:00:00,HR,1e2,b
data/tuning/0.parquet:
  - {subject_id: 3, code: HR, numeric_value: 70, note: c}
"""


def folder_of(tmp_path, **files):
    stage = tmp_path / "drop_some"
    (stage / "examples/deep/er").mkdir(parents=True)
    (stage / "config.yaml").write_text("regex: ^T\n")
    for name, text in files.items():
        at, _, file = name.rpartition("/")
        (stage / "examples" / at).mkdir(parents=True, exist_ok=True)
        (stage / "examples" / at / file).write_text(text)
    return stage


def test_a_stage_folder_runs_its_scenarios(spark, tmp_path):
    """Own inputs and the caller's, own settings, an expected error, and what is said of a wrong result."""
    left = "data: |-\n  subject_id,time,code,numeric_value,note\n  1,,EYES,,\n  1,2020-01-02 10:00:00,HR,60.0001,a\n  2,2020-01-03,HR,100,b\n  3,,HR,70,c\n"
    r = builtin()
    stage = r.add_folder(folder_of(tmp_path, **{
        "own/in.yaml": IN, "own/out_data.yaml": left,
        "deep/er/in.yaml": IN, "deep/er/cfg.yaml": "regex: ''\nno_such: 1\n", "deep/er/error.txt": "no setting.*no_such",
        "wrong/in.yaml": IN, "wrong/cfg.yaml": "regex: ^HR", "wrong/out_data.yaml": left,
        "given/cfg.yaml": "regex: .", "given/out_data.yaml": "data: |-\n  subject_id,time,code,numeric_value\n",
    }), r["drop_regex"].fn)
    found = examples.of_stage(stage)
    assert [s.name for s in found] == ["deep/er", "given", "own", "wrong"]
    for s in found:
        run = lambda s=s: examples.check(spark, "drop_some", s, r, tmp_path / "run" / s.name, lambda at: events(spark, False).write.parquet(f"{at}/data/0"))
        if s.name == "wrong":
            with pytest.raises(AssertionError, match="rows instead of 4"):
                run()
        else:
            run()
    with pytest.raises(ValueError, match="no input"):
        examples.check(spark, "drop_some", found[1], r, tmp_path / "none")
    assert examples.of_stage(r["normalization"]) == []


def test_scenario_of_metadata(spark, tmp_path):
    expect = "metadata/codes.parquet:\n" + "".join(f"  - {{code: '{c}', code/n_subjects: {n}}}\n" for c, n in (("EYES", 1), ("HR", 2), ("TEMP", 1)))
    (tmp_path / "examples").mkdir()
    (tmp_path / "examples/in.yaml").write_text(IN)
    (tmp_path / "examples/cfg.yaml").write_text("aggregations: [code/n_subjects]")
    (tmp_path / "examples/out_metadata.yaml").write_text(expect)
    (one,) = examples.scenarios(tmp_path / "examples")
    examples.check(spark, "aggregate_code_metadata", one, builtin(), tmp_path / "run")
    one.metadata["metadata/codes.parquet"][1]["code/n_subjects"] = 3
    with pytest.raises(AssertionError, match="row 1, code/n_subjects: 2 instead of 3"):
        examples.check(spark, "aggregate_code_metadata", one, builtin(), tmp_path / "run")


def package(tmp_path, name, body, points):
    (tmp_path / f"{name}.py").write_text(body)
    info = tmp_path / f"{name}-1.0.dist-info"
    info.mkdir()
    (info / "METADATA").write_text(f"Metadata-Version: 2.1\nName: {name}\nVersion: 1.0\n")
    (info / "entry_points.txt").write_text("[eventspark.stages]\n" + "\n".join(points))


def test_stages_of_installed_packages(spark, tmp_path, monkeypatch):
    """Found by entry points, from Python as from the command line; one name in two packages, or a built-in one, is refused."""
    package(tmp_path, "plug_one", "from eventspark.plans.registry import Stage\ndef keep_hr(df):\n    return df.where(\"code = 'HR'\")\ndef first(df, n=1):\n    return df.limit(n)\nheld = Stage('first_rows', first, 'map', {'n': 2})\n", ["keep_hr = plug_one:keep_hr", "first_rows = plug_one:held"])
    monkeypatch.syspath_prepend(str(tmp_path))
    assert {"keep_hr", "first_rows"} <= set(installed())
    rows = Pipeline.from_config({"stages": ["keep_hr", "first_rows"]}).apply(events(spark, False))[0].collect()
    assert [r["code"] for r in rows] == ["HR", "HR"]
    package(tmp_path, "plug_two", "def keep_hr(df):\n    return df\n", ["keep_hr = plug_two:keep_hr"])
    with pytest.raises(ValueError, match="keep_hr"):
        installed()
    (tmp_path / "plug_two-1.0.dist-info/entry_points.txt").write_text("[eventspark.stages]\nnormalization = plug_two:keep_hr\n")
    with pytest.raises(ValueError, match="normalization"):
        installed()


def test_search_among_many_endpoints(spark):
    for n in (1, 16, 17, 32, 33, 1000):
        ends = F.array(*[F.lit(float(3 * (i // 2))) for i in range(n)])  # every endpoint twice
        df = spark.range(3 * n + 20).select(F.explode(F.array(F.col("id") - 7.5, F.col("id").cast("double"), F.lit(float("nan")), F.lit(float("-inf")))).alias("v"), ends.alias("e"))
        assert df.where(~values.ends_up_to(F.col("e"), F.col("v")).eqNullSafe(F.size(F.filter("e", lambda e: e <= F.col("v"))))).isEmpty(), n


def test_bins_of_many_endpoints(spark):
    ends = [float(x) for x in range(0, 3000, 3)]
    meta = spark.createDataFrame([("A", ends)], "code string, ends array<double>")
    df = spark.range(3100).select(F.lit("A").alias("code"), (F.col("id") - 20.5).alias("numeric_value"))
    got = {r["numeric_value"]: r["code"] for r in values.bin_numeric_values(df, meta, ["ends"]).collect()}
    assert (got[-0.5], got[0.5], got[2998.5]) == ("A//value_[-inf,0.0)", "A//value_[0.0,3.0)", "A//value_[2997.0,inf)")
    assert len(set(got.values())) == 1001
