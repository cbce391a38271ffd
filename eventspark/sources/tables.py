"""Reading and writing event tables, code metadata, splits and shard maps."""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.sources import wide_csv

#: Name of the column that carries the order of rows through a plan; absent if order doesn't matter.
ORDER = "__ord"
SORT = ("subject_id", "time")
#: Bits of a carried order that hold a row's place in its file.
ROW_BITS = 40
_SCHEME = "^[^:/]+:/*"


def read_events(spark: SparkSession, path: str | list[str], prefix: str | None = None, keep_order: bool = False, where=None) -> DataFrame:
    """All Parquet shards below ``path`` as one frame; timestamps without a zone become UTC timestamps.

    ``path`` may be a list of folders or shards, none of them twice. ``prefix`` restricts to a folder below, ``where``
    is pushed to the scan, ``keep_order`` adds the position of each row within its file. A path without a shard raises
    ``FileNotFoundError``.
    """
    roots = [f"{p.rstrip('/')}/{prefix.strip('/')}" if prefix else p for p in once_each([path] if isinstance(path, str) else path)]
    for root in roots:
        _need(spark, root)
    df = spark.read.option("recursiveFileLookup", "true").parquet(*roots)
    if where is not None:
        df = df.where(where)
    return utc(with_order(df, roots) if keep_order else df)


def with_order(df: DataFrame, roots: list[str], most: int = 100_000) -> DataFrame:
    """Adds the order of the scanned rows of ``roots`` as one long: the file's place by path, then the row's place in it
    (40 bits). Up to ``most`` files their places are sent to all tasks; of more, each row carries its file's path."""
    spark = df.sparkSession
    files = sorted({k for root in roots for k in file_keys(spark, root)})
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if len(files) > most:
        return df.select("*", F.struct(path.alias("f"), row.alias("i")).alias(ORDER))
    at = {k: i << ROW_BITS for i, k in enumerate(files)}
    # Local paths are written with one slash or three; comparing both is cheaper than bringing each row's to one form.
    forms = {form for root in roots for f in _files(spark, root) for form in _forms(str(f.getPath().toUri().toString()))}
    places = spark.createDataFrame([(f, at[re.sub(_SCHEME, "", f)]) for f in sorted(forms)], "__file string, __place long")
    own = df.select("*", path.alias("__of"), row.alias("__row"))
    joined = own.join(F.broadcast(places), F.col("__of") == F.col("__file"), "left")
    place = F.coalesce("__place", F.raise_error(F.concat(F.lit("A row of a file that was not listed: "), "__of")).cast("long"))
    return joined.withColumn(ORDER, place.bitwiseOR(F.col("__row"))).drop("__of", "__row", "__file", "__place")


def _forms(uri: str) -> set[str]:
    scheme, _, rest = uri.partition(":")
    return {uri, f"{scheme}:/{rest.lstrip('/')}", f"{scheme}:///{rest.lstrip('/')}"} if not rest.startswith("//") or rest.startswith("///") else {uri}


def utc(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def once_each(names: list[str]) -> list[str]:
    """The names of shards, if none stands twice."""
    if twice := sorted(n for n, k in Counter(names).items() if k > 1):
        raise ValueError(f"Shards stand more than once: {twice}")
    return list(names)


def _files(spark: SparkSession, root: str):
    """Status of each Parquet file at or below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    if fs.getFileStatus(path).isFile():
        yield fs.getFileStatus(path)
        return
    files = fs.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        if f.getPath().getName().endswith(".parquet"):
            yield f


def has_shards(spark: SparkSession, root: str) -> bool:
    return next(_files(spark, root), None) is not None


def _need(spark: SparkSession, root: str) -> None:
    if not has_shards(spark, root):
        raise FileNotFoundError(f"No shards below {root}")


def file_marks(spark: SparkSession, root: str) -> list[list]:
    """Name, size and time of change of each shard, by name: what a rerun compares."""
    return sorted([str(f.getPath()), int(f.getLen()), int(f.getModificationTime())] for f in _files(spark, root))


def file_keys(spark: SparkSession, root: str) -> dict[str, tuple[str, int, int]]:
    """Of each shard, by what ``file_key`` makes of its path: path, size and time of change."""
    return {re.sub(_SCHEME, "", str(f.getPath().toUri().toString())): (str(f.getPath()), int(f.getLen()), int(f.getModificationTime())) for f in _files(spark, root)}


def file_key(path: Column) -> Column:
    """The file of a ``_metadata.file_path``: the path without the scheme and the slashes after it, which readers write in several
    ways."""
    return F.regexp_replace(path, _SCHEME, "")


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders in ``root``, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()) if fs.exists(path) else []


def complete_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders in ``root`` that a finished write of Spark left."""
    return [n for n in folders(spark, root) if is_complete(spark, f"{root}/{n}")]


def shard_files(spark: SparkSession, root: str, out_root: str, prefix: str = "", out_suffix: str = ".parquet", train_only: bool = False) -> dict[str, tuple[str, str]]:
    """shard name -> (file read, file to write), by name. A name is the path below ``root`` without its suffix;
    ``prefix`` picks those that begin so, ``train_only`` those of the ``train`` folder, if there are any."""
    base = str(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()).rstrip("/") + "/"
    paths = [str(f.getPath().toUri().getPath()) for f in _files(spark, root)]
    names = {p[len(base) :].removesuffix(".parquet"): p for p in sorted(paths)}
    names = {n: p for n, p in names.items() if n.startswith(prefix)}
    if train_only and any(n.startswith("train/") for n in names):
        names = {n: p for n, p in names.items() if n.startswith("train/")}
    if not names:
        raise FileNotFoundError(f"No shards below {root} begin with '{prefix}'")
    return {n: (p, f"{out_root.rstrip('/')}/{n}{out_suffix}") for n, p in names.items()}


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of_split(df: DataFrame, splits: DataFrame, split: str = "train") -> DataFrame:
    """Rows of the subjects of one split."""
    return df.join(splits.where(F.col("split") == split).select("subject_id").distinct(), "subject_id", "left_semi")


def wide_to_events(df: DataFrame, id_col: str = "subject_id") -> DataFrame:
    """Static events from a wide table: each other column becomes a code; text that is no number gives a null value,
    as does a null cell."""
    cols = [c for c in df.columns if c != id_col]
    text = df.select(F.col(id_col).cast("long").alias("subject_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long_ = text.unpivot("subject_id", [F.col(f"`{c}`") for c in cols], "code", "v")
    return long_.select("subject_id", F.lit(None).cast("timestamp").alias("time"), "code", F.expr("try_cast(v AS float)").alias("numeric_value"))


def read_wide_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return wide_to_events(spark.read.options(header="true", **options).csv(path))


def cells_to_events(cells: DataFrame) -> DataFrame:
    """Static events from ``id, code, cell``; text that is no number gives a null value, as does a null cell."""
    value = F.expr("try_cast(cell AS float)").alias("numeric_value")
    return cells.select(F.col("id").cast("long").alias("subject_id"), F.lit(None).cast("timestamp").alias("time"), "code", value)


def wide_csv_to_events(spark: SparkSession, path: str, id_col: str = "subject_id") -> DataFrame:
    """Static events of all wide CSV files of a folder or pattern; files may differ in columns, and those without the
    id column are passed over.

    One job reads all files, headers included (``sources.wide_csv``). In stores that only Spark reaches, Spark's own
    reader looks at each file's header first, a job for each.
    """
    if wide_csv.reaches(path):
        if not wide_csv.csv_files(path):
            raise FileNotFoundError(f"No CSV file at {path}")
        return cells_to_events(wide_csv.read_cells(spark, path, id_col))
    return _by_header(spark, path, id_col)


def _by_header(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(folder) if fs.exists(folder) and fs.getFileStatus(folder).isDirectory() else fs.globStatus(folder) or []
    names = sorted(str(f.getPath()) for f in found if f.getPath().getName().endswith(".csv"))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for name in names:
        by_header.setdefault(tuple(spark.read.csv(name, header=True).columns), []).append(name)
    tables = [spark.read.csv(of, header=True, schema=", ".join(f"`{c}` string" for c in header)) for header, of in by_header.items() if id_col in header]
    if not tables:
        raise FileNotFoundError(f"No CSV file with a column '{id_col}' at {path}")
    every = [wide_to_events(t, id_col) for t in tables]
    return reduce(DataFrame.unionByName, every)


def codes_of(df: DataFrame) -> DataFrame:
    """Minimal code metadata: each code once, without a description or parents."""
    none = F.lit(None)
    return df.select("code").where("code is not null").distinct().select("code", none.cast("string").alias("description"), none.cast("array<string>").alias("parent_codes"))


def sorted_codes(meta: DataFrame) -> DataFrame:
    """Metadata in the order of its codes, as the sink writes it."""
    return meta.orderBy(F.col("code").asc_nulls_first())


def sorted_for_sink(df: DataFrame) -> DataFrame:
    """Each subject in one partition, rows by subject, time (null first) and the carried order."""
    order = [F.col(c).asc_nulls_first() for c in SORT] + ([F.col(ORDER).asc()] if ORDER in df.columns else [])
    return df.repartition("subject_id").sortWithinPartitions(*order).drop(ORDER)


def write_events(df: DataFrame, path: str, shards: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Sorted Parquet; with ``shards`` (subject_id, split, shard), or where the rows have ``split`` and ``shard``, as
    ``split=S/shard=I`` folders."""
    if shards is not None:
        df = df.drop("split", "shard").join(shards.select("subject_id", "split", "shard"), "subject_id")
    if not {"split", "shard"} <= set(df.columns):
        sorted_for_sink(df).write.mode(mode).parquet(path)
        return
    order = [F.col(c).asc_nulls_first() for c in SORT] + ([F.col(ORDER).asc()] if ORDER in df.columns else [])
    placed = df.repartition("split", "shard").sortWithinPartitions("split", "shard", *order).drop(ORDER)
    placed.write.mode(mode).partitionBy("split", "shard").parquet(path)


def is_complete(spark: SparkSession, path: str, mark: str | None = None) -> bool:
    """Whether Spark's commit marker is there, and the one of ``sign`` with that mark."""
    names = ["_SUCCESS", *([f"_made-by-{mark}"] if mark else [])]
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{n}") for n in names]
    return all(bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)) for p in paths)


def sign(spark: SparkSession, path: str, mark: str) -> None:
    """Say beside a finished table what it was made by; writing the table anew takes the mark away."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_made-by-{mark}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(p)


def once(df: DataFrame, path: str, mark: str, overwrite: bool = False) -> DataFrame:
    """``df`` written at ``path``, unless it is there with the same mark, and read again."""
    spark = df.sparkSession
    if overwrite or not is_complete(spark, path, mark):
        df.write.mode("overwrite").parquet(path)
        sign(spark, path, mark)
    return spark.read.parquet(path)


def shard_map_json(shards: DataFrame, most: int = 1_000_000) -> str:
    """``{"split/i": [ids]}`` for datasets of at most ``most`` subjects; larger ones keep the table."""
    if (n := shards.count()) > most:
        raise ValueError(f"{n} subjects are too many for one JSON text (at most {most}); write the table instead")
    rows = shards.groupBy("split", "shard").agg(F.array_sort(F.collect_list("subject_id")).alias("ids")).orderBy("split", "shard").collect()
    return json.dumps({f"{r['split']}/{r['shard']}": r["ids"] for r in rows})


def read_shard_map(spark: SparkSession, text: str) -> DataFrame:
    rows = [(int(i), *k.rsplit("/", 1)) for k, ids in json.loads(text).items() for i in ids]
    return spark.createDataFrame([(i, s, int(n)) for i, s, n in rows], "subject_id long, split string, shard int")
