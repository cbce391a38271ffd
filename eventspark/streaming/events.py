"""The stateless operators on streams, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from eventspark.plans.pipeline import Pipeline

#: Stages that look at one row and static metadata only, so that they work on a stream as they are.
STATELESS = ("filter_measurements", "drop_regex", "normalization", "occlude_outliers", "bin_numeric_values", "extract_values")


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def apply_stateless(stream: DataFrame, pipeline: Pipeline, meta: DataFrame | None = None) -> DataFrame:
    """A pipeline of stateless stages over a stream, joined with static code metadata."""
    if bad := [s.base for s in pipeline.steps if s.base not in STATELESS]:
        raise ValueError(f"These stages need more than one row and don't run on a stream: {bad}")
    return pipeline.apply(stream, meta)[0]


def windowed_counts(stream: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Measurements per code and window of event time; rows later than ``late`` are dropped."""
    return stream.withWatermark("time", late).groupBy(F.window("time", every), "code").agg(F.count(F.lit(1)).alias("n"), F.sum("numeric_value").alias("total"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, then stop; a rerun goes on where this one ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
