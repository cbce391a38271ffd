"""Repeated line runs by a suffix array over line ids, ranked by distributed prefix doubling; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventspark.llm.common import WORD_GAP, materialize

_DOC = ["doc", "th"]
_RANK = ["h", "g", "off"]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, pos, line_no, words, h, g) of lines with a word; pos counts those. h, g identify the line."""
    parts = F.transform(F.split(F.col("text"), "\n", -1), lambda x, i: F.struct(i.alias("line_no"), F.size(F.array_remove(F.split(x, WORD_GAP), "")).alias("words"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(77), x).alias("g")))
    own = docs.select(_doc_key(F.col(id_col)).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("text is not null")
    own = own.select(*_DOC, F.posexplode(F.filter(parts, lambda s: s["words"] > 0)).alias("pos", "s"))
    return own.select(*_DOC, "pos", "s.line_no", F.col("s.words").cast("long").alias("words"), "s.h", "s.g")


def _doc_key(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(-(1 << 63)))


def _next_ranks(ranks: DataFrame, step: int) -> DataFrame:
    """Prefix doubling: from the ranks of suffixes by their first ``step`` lines to those by twice as many, for the
    suffixes whose longer prefix occurs twice or more. A rank is (line id, offset in the line id's stretch of the
    suffix array); equal ranks are an interval of suffixes with that many lines in common.

    Only distinct pairs of ranks are ordered within a rank, so a very common line costs a partial count, not a sort
    of all its suffixes; and they are ordered in 256 chunks by the next line's id, so that no task orders all that
    follows a common line."""
    nxt = ranks.select(*_DOC, (F.col("pos") - step).alias("pos"), *[F.col(c).alias(f"n_{c}") for c in _RANK])
    pairs = ranks.join(nxt, [*_DOC, "pos"])
    n_rank = [f"n_{c}" for c in _RANK]
    kinds = pairs.groupBy(*_RANK, *n_rank).agg(F.count(F.lit(1)).alias("c"))
    kinds = kinds.withColumn("chunk", F.shiftright("n_h", 56))
    before = Window.partitionBy(*_RANK, "chunk").orderBy(*n_rank).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*_RANK).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = kinds.groupBy(*_RANK, "chunk").agg(F.sum("c").alias("of")).withColumn("from", F.coalesce(F.sum("of").over(lower), F.lit(0))).drop("of")
    kinds = kinds.withColumn("within", F.coalesce(F.sum("c").over(before), F.lit(0))).where("c > 1").join(chunks, [*_RANK, "chunk"])
    kinds = kinds.withColumn("add", F.col("from") + F.col("within")).drop("chunk", "within", "from")
    got = pairs.join(kinds.drop("c"), [*_RANK, *n_rank])
    return got.select(*_DOC, "pos", "h", "g", (F.col("off") + F.col("add")).alias("off"))


def repeated_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, line_no) of every line inside a run of lines with ``min_words`` words or more that also occurs
    earlier, in the order of document id and line.

    Every maximal repeated run with enough words is the union of the shortest such runs that start, and that end,
    at its lines (a line that neither covers would start one itself). A run of m lines is named by two overlapping
    ranks of 2**k lines, so all suffixes in one interval of the suffix array whose longest common prefix is m or
    more meet under one name; of each, the first stays and the later copies go.
    """
    lines = materialize(_lines(docs, id_col, text_col), "lines")
    again = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "g")

    upto = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    once = lines.repartition(*_DOC).distinct()  # rows repeated with id and text count once; dealt as the windows are
    placed = once.withColumn("end", F.sum("words").over(upto)).withColumn("start", F.col("end") - F.col("words"))
    ahead = Window.partitionBy(*_DOC).orderBy("start").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*_DOC).orderBy("end").rangeBetween(-(min_words - 1), 0)
    placed = placed.select(*_DOC, "pos", "h", "g", F.count(F.lit(1)).over(ahead).alias("m"), (F.max("end").over(ahead) - F.col("start")).alias("w"), F.count(F.lit(1)).over(back).alias("m_back"), (F.col("end") - F.min("start").over(back)).alias("w_back"))
    alive = materialize(placed.join(again, ["h", "g"], "left_semi"), "line-alive")
    runs = alive.where(F.col("w") >= min_words).select(*_DOC, "pos", F.col("m").cast("int").alias("m"))
    runs = runs.unionByName(alive.where(F.col("w_back") >= min_words).select(*_DOC, (F.col("pos") - F.col("m_back") + 1).cast("int").alias("pos"), F.col("m_back").cast("int").alias("m"))).distinct()
    level = F.floor(F.log2(F.col("m") + 0.5)).cast("int")
    runs = materialize(runs.withColumn("level", level), "line-runs")
    top = runs.agg(F.max("level")).collect()[0][0]

    ranks = alive.select(*_DOC, "pos", "h", "g", F.lit(0).cast("long").alias("off")).distinct()
    levels = [ranks.withColumn("level", F.lit(0))]
    for k in range(top or 0):
        ranks = materialize(_next_ranks(ranks, 1 << k), "line-ranks")
        levels.append(ranks.withColumn("level", F.lit(k + 1)))
    every = reduce(DataFrame.unionByName, levels)
    tail = every.select(*_DOC, "level", F.col("pos").alias("tail_pos"), *[F.col(c).alias(f"t_{c}") for c in _RANK])
    named = runs.join(every, [*_DOC, "level", "pos"]).withColumn("tail_pos", (F.col("pos") + F.col("m") - F.pow(F.lit(2), F.col("level")).cast("int")).cast("int")).join(tail, [*_DOC, "level", "tail_pos"])
    name = ["m", *_RANK, *[f"t_{c}" for c in _RANK]]
    first = named.groupBy(*name).agg(F.min(F.struct("doc", "th", "pos")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = named.join(first, name).where(F.struct("doc", "th", "pos") > F.col("first")).select(*_DOC, "pos", "m")
    gone = later.select(*_DOC, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("pos")).distinct()
    return gone.join(lines, [*_DOC, "pos"]).select(*_DOC, "line_no").distinct()


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``gone`` (numbers of the deleted lines, from 0, in order) and ``kept_text``.

    Lines end at U+000A. Lines without a word don't count as part of a run and stay. Null text: no lines, nothing
    gone, kept text null; empty text: one line. Rows with the same id and text are one document and get the same
    result; rows without an id count as one id that comes first. Other columns stay; columns of the added names are
    replaced. An empty table gives an empty result.
    """
    gone = repeated_lines(docs, min_words, id_col, text_col).groupBy(*_DOC).agg(F.array_sort(F.collect_list("line_no")).alias("gone"))
    own = docs.drop("n_lines", "gone", "kept_text").withColumn("__doc", _doc_key(F.col(id_col))).withColumn("__th", F.xxhash64(text_col))
    gone = gone.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), "gone")
    out = own.join(gone, ["__doc", "__th"], "left").drop("__doc", "__th").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    lines = F.split(F.col(text_col), "\n", -1)
    # The lines are bound once; the numbers that stay are a difference of sets, so that the work is linear in the lines.
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
    kept = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n"))[0]
    return out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines"))).withColumn("kept_text", F.when(F.size("gone") == 0, F.col(text_col)).otherwise(kept))
