"""Event tables laid out by subject: bucketed files, over which windows, groups and joins by subject shuffle nothing."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.sources.tables import ORDER, SORT, is_complete, sign


def _ident(path: str) -> str:
    return f"by_subject_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_by_subject(df: DataFrame, path: str, buckets: int, mode: str = "errorifexists") -> None:
    """Write rows into ``buckets`` buckets by subject, one file each, sorted by subject, time (null first) and the carried
    order, which stays as a column. Tables that are to be read together need the same number of buckets; take as many as
    bring a bucket to a few hundred MB."""
    order = [c for c in (*SORT, ORDER) if c in df.columns]
    dealt = df.repartition(buckets, "subject_id")  # as buckets are, so that a bucket is one file
    name = _ident(path)
    dealt.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    dealt.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, "subject_id").sortBy(*order).saveAsTable(name)
    dealt.sparkSession.sql(f"DROP TABLE {name}")  # the files stay; the next reader names them anew
    sign(df.sparkSession, path, f"buckets-{buckets}")


def buckets_of(spark: SparkSession, path: str) -> int:
    """Number of buckets that ``write_by_subject`` wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_made-by-buckets-*"))
    if not found or not is_complete(spark, path):
        raise FileNotFoundError(f"No complete table by subject at {path}")
    return int(str(found[0].getPath().getName()).rsplit("-", 1)[1])


def read_by_subject(spark: SparkSession, *paths: str) -> DataFrame:
    """The table at a path, or the rows of the tables at several, known to Spark as bucketed by subject: a stage that
    works by subject, or a join of two such frames, needs no exchange of their rows. Columns that one table lacks are
    null.

    Several tables become partitions of one, so that a bucket of all of them is one task's. A union of two frames isn't
    the same: Spark 4.1 takes it to be dealt by subject too, but counts a subject once for each side.
    """
    sizes = {buckets_of(spark, p) for p in paths}
    if len(sizes) != 1:
        raise ValueError(f"Tables by subject are read bucket by bucket, so they need one number of buckets: {paths}")
    name, kinds = _ident("\n".join(paths)), {}
    for p in paths:
        for f in spark.read.parquet(p).schema:
            if kinds.setdefault(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
                raise ValueError(f"'{f.name}' has other types in some of {paths}")
    fields, order = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()), ", ".join(f"`{c}`" for c in (*SORT, ORDER) if c in kinds)
    places = [_location(spark, p) for p in paths]
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    parts = (", __part int", "PARTITIONED BY (__part)") if len(paths) > 1 else ("", "")
    spark.sql(f"CREATE TABLE {name} ({fields}{parts[0]}) USING parquet {parts[1]} CLUSTERED BY (subject_id) SORTED BY ({order}) INTO {sizes.pop()} BUCKETS LOCATION '{places[0]}'")
    for i, place in enumerate(places if len(places) > 1 else []):
        spark.sql(f"ALTER TABLE {name} ADD PARTITION (__part={i}) LOCATION '{place}'")
    return spark.table(name).drop("__part")


def _location(spark: SparkSession, path: str) -> str:
    """The path with its scheme, with quotes escaped for SQL."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p)
    return str(whole.toString()).replace("\\", "\\\\").replace("'", "\\'")


def sorted_in_place(df: DataFrame) -> DataFrame:
    """Rows of ``read_by_subject`` in the order that the sink writes, without an exchange."""
    order = [F.col(c).asc_nulls_first() for c in SORT] + ([F.col(ORDER).asc()] if ORDER in df.columns else [])
    return df.sortWithinPartitions(*order)
