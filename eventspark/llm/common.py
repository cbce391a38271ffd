"""Shared pieces: tables, scratch tables, folds, numbering, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.functions.numbering import numbered, ordered
from eventspark.sources.scratch import discard, materialize, purge_scratch, scratch_root

__all__ = ["WORD_GAP", "bound_batches", "discard", "held_out", "materialize", "numbered", "ordered", "purge_scratch", "scratch_root", "table", "words_of"]

#: White space that separates words for word counts and shingles: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Rows go to Python workers in Arrow batches that end with the row that reaches ``most`` bytes.

    Spark bounds their rows alone, so that whole texts fill tens of MB a task on either side. No row is cut or lost. The
    setting stays in the session, as plans read it when they run; a smaller one of the session holds.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > most:
        spark.conf.set(key, str(most))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, mod 5, is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: Column, gap: str = WORD_GAP) -> Column:
    """The words between gaps; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")
