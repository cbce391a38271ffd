"""Benchmark decontamination with DataFrame operations only: a broadcast set of test n-grams, window scans, exact checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.common import materialize

#: Separates words of lower-cased text: every ASCII character but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_words(text: Column) -> Column:
    """Words after lower-casing A-Z only; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _gram(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + F.lit(j)) for j in range(n)])


def _starts(words: Column, n: int) -> Column:
    last = F.size(words) - n
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _holds(words: Column, n: int, grams: list[int]) -> Column:
    """Whether any n-word gram is in the hash set of ``grams``."""
    return F.exists(_starts(words, n), lambda i: _gram(words, i, n).isin(grams))


def _grams(words: Column, n: int) -> Column:
    """(len, h) of every n-word gram, as an array."""
    return F.transform(_starts(words, n), lambda i: F.struct(F.lit(n).alias("len"), _gram(words, i, n).alias("h")))


def _windows(words: Column, n: int) -> Column:
    """(at, len, gram) of every n-word window, as an array."""
    return F.transform(_starts(words, n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram")))


def benchmark_windows(bench: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, len, gram): distinct windows of n words; an item of fewer, but not none, is one window."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), ascii_words(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    long_ = items.where(F.size("w") >= n).select("item", F.lit(n).alias("len"), F.explode(_windows(F.col("w"), n)).alias("x")).select("item", "len", "x.gram")
    short = items.where(F.size("w") < n).select("item", F.size("w").alias("len"), F.array_join("w", " ").alias("gram"))
    return long_.unionByName(short).distinct()


def _with_anchor(words: DataFrame, anchors: DataFrame, id_col: str) -> DataFrame:
    """``words`` with the text of the rows that hold an anchor, found by a join on gram hashes; null for the others."""
    grams = F.array().cast("array<struct<len:int,h:bigint>>")
    for m in sorted(r["len"] for r in anchors.select("len").distinct().collect()):
        grams = F.concat(grams, F.array_distinct(_grams(F.col("aw"), m)))
    each = words.select(id_col, "of", F.explode(grams).alias("x")).select(id_col, "of", "x.len", "x.h")
    held = each.join(anchors, ["len", "h"], "left_semi").select(F.col(id_col).alias("__id"), F.col("of").alias("__of")).distinct()
    held = materialize(held, "decontam-held").withColumn("__held", F.lit(True))
    out = words.join(held, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__of")), "left")
    return out.select(id_col, "n_words", "of", F.when(F.col("__held"), F.col("text")).alias("text"))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 13, min_share: tuple[int, int] = (1, 20), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", broadcast_rows: int = 20_000) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``hit_at``.

    A document word inside any occurrence of a benchmark window is hit; ``hit_at`` lists the hit word positions in
    order. A document is contaminated if hits > 0 and their share is at least ``min_share``.

    Every window of n words holds an anchor: a short gram of the item that starts at a fixed stride. The set of
    anchors is counted first; up to ``broadcast_rows`` of them are shipped as a hash set and each document's words
    are scanned against it. Beyond that size the hashes of the documents' grams meet the written anchors in a semi join,
    whose hash table Spark ships or shuffles by its measured size. Either way the documents with an anchor alone are
    compared window by window with the exact texts.

    Null or word-less text: no words, no hits, not contaminated. Null items or item ids and an empty benchmark hit
    nothing. Repeated document rows are judged each; equal ids with unequal texts are kept apart. Very long texts are
    scanned whole; an empty table gives an empty result, and other columns of either table are ignored.
    """
    size = min(6, (n + 1) // 2)  # words of an anchor
    stride = n - size + 1
    grams = bench.select(F.col(item_col).alias("item"), ascii_words(F.col(bench_text)).alias("w")).where("item is not null and size(w) > 0")
    full = grams.where(F.size("w") >= size).select(F.lit(size).alias("len"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - size, F.lit(stride)), lambda i: _gram(F.col("w"), i, size))).alias("h"))
    less = grams.where(F.size("w") < size)
    anchors = full
    for m in range(1, size):
        anchors = anchors.unionByName(less.where(F.size("w") == m).select(F.lit(m).alias("len"), _gram(F.col("w"), F.lit(0), m).alias("h")))
    anchors = materialize(anchors.distinct(), "decontam-anchors")
    kept = [(r["len"], r["h"]) for r in anchors.limit(broadcast_rows + 1).collect()]
    # The windows are written first: their measured size, not that of the anchors, lets Spark broadcast them or not.
    windows = materialize(benchmark_windows(bench, n, item_col, bench_text), "decontam-windows")

    base = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    words = base.withColumn("aw", ascii_words(F.col("text"))).withColumn("n_words", F.size("aw").cast("long")).withColumn("of", F.xxhash64("text"))
    if len(kept) <= broadcast_rows:
        maybe = F.lit(False)
        for m in sorted({k for k, _ in kept}):
            maybe = maybe | _holds(F.col("aw"), m, [h for k, h in kept if k == m])
        seen = words.select(id_col, "n_words", "of", F.when(maybe, F.col("text")).alias("text"))
    else:
        seen = _with_anchor(words, anchors, id_col)
    seen = materialize(seen, "decontam-seen")
    lens = [r["len"] for r in windows.select("len").distinct().collect()]
    every = F.array().cast("array<struct<at:int,len:int,gram:string>>")
    for m in lens:
        every = F.concat(every, _windows(F.col("w"), m))
    exact = seen.where("text is not null").withColumn("w", ascii_words(F.col("text")))
    hits = exact.select(id_col, "n_words", "of", F.explode(every).alias("x")).select(id_col, "n_words", "of", "x.at", "x.len", "x.gram").join(windows, ["len", "gram"])
    by = [id_col, "n_words", "of"]
    per = hits.groupBy(*by).agg(F.array_sort(F.collect_set("item")).alias("items"), F.collect_set(F.struct("at", "len")).alias("runs"))
    per = per.select(*[F.col(c).alias(f"_{c}") for c in by], "items", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["len"] - 1))))).alias("hit_at"))
    left = seen.select(*by)
    on = left[id_col].eqNullSafe(per[f"_{id_col}"]) & (left["n_words"] == per["_n_words"]) & (left["of"] == per["_of"])
    out = left.join(per, on, "left")
    n_hit = F.coalesce(F.size("hit_at"), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return out.select(
        id_col,
        "n_words",
        F.when(F.col("hit_at").isNull(), F.lit(0)).otherwise(n_hit).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        F.when(F.col("hit_at").isNull(), F.lit(False)).otherwise(n_hit * min_share[1] >= F.col("n_words") * min_share[0]).alias("contaminated"),
        F.coalesce("hit_at", F.array().cast("array<int>")).alias("hit_at"),
    )
