"""Corpus pipeline: language ID, n-gram near duplicates, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import decontam, langid, mixing, ngram_join, sharding
from eventspark.llm.common import bound_batches, discard, held_out, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID. Documents without a letter go (their language is ``und``); every document that a learned
    language can be told for stays, however unsure."""
    bound_batches(spark)
    model = langid.fit_languages(docs, ~held_out("doc_id"))
    if not model.members:  # no labelled text at all: only letterless texts can be rejected
        model = langid.train(["a"], ["en"])
    return langid.identify(docs.select(*COLUMNS), model).where(F.col("lang_pred") != langid.UND).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``: id and text, so that rows without an id, or with one id and several texts, are apart."""
    return docs.select(*COLUMNS, F.struct(F.col("doc_id"), F.xxhash64("text").alias("of")).alias("__key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the document with the smallest id stays. Word-less texts link with
    nothing and stay; rows without an id cannot be told apart by id and stay. Rows repeated with id and text stay
    once; an id with several texts is one document, and stays or goes with all of them."""
    bound_batches(spark)
    comps = ngram_join.join_components(docs, k=5, num=4, den=5)
    # Written first: its measured size decides whether the texts are shuffled to meet it.
    gone = materialize(comps.where("component_id is not null and doc_id <> component_id").select("doc_id").distinct(), "pipeline-gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents of which a twentieth of the words or more lies in benchmark windows go,
    each judged by its own text, with or without an id."""
    own = _keyed(docs)
    found = decontam.decontaminate(own, table(spark, sf_dir, "benchmark"), n=13, id_col="__key")
    gone = materialize(found.where("contaminated").select(F.col("__key").alias("__gone")).distinct(), "pipeline-gone")
    return own.join(gone, F.col("__key").eqNullSafe(F.col("__gone")), "left_anti").select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document comes as many times as the mix takes it (0, 1 or 2). Word-less documents weigh nothing
    and stay once. Rows with equal id and text come as often as the most taken one of them."""
    own = _keyed(docs)
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    copies = mixing.mix_sources(own, id_col="__key").groupBy(F.col("__key").alias("__id")).agg(F.max(copies).alias("copies"))
    out = own.join(materialize(copies, "pipeline-copies"), F.col("__key").eqNullSafe(F.col("__id"))).where("copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: eight shards of nearly equal bytes; the copies of a document lie in one shard. Rows without a text are
    a group of their own, rows without an id are placed as any."""
    return sharding.shard_by_bytes(docs, n_shards=8).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_to_weights),
    ("shard", shard),
]

#: SQL expresses neither the trained classifier nor the fitted mix; tests compare the join and
#: the decontamination with brute force, the mix with its operator's copies and budgets.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)  # the next stage's table is whole; one copy of the corpus lies there at a time
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
