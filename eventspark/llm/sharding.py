"""Shards of nearly equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventspark.llm.common import materialize, numbered


def difference(parts: list[list[int]], k: int) -> list[list[int]]:
    """k-way Karmarkar-Karp over partial partitions.

    ``parts[i]`` holds k sums (missing ones are 0). The two partial partitions with the largest spread are
    added in opposite order until one is left. Returns ``place`` with ``place[i][j]`` = the final subset that
    sum j of part i lies in.
    """
    n = len(parts)
    if not n:
        return []
    sums: list[list[int]] = []
    order: list[list[int]] = []  # of a node: which own subset stands at each place of the sorted sums
    heap = []
    for i, p in enumerate(parts):
        p = [*p, *[0] * (k - len(p))]
        idx = sorted(range(k), key=lambda j: (-p[j], j))
        sums.append([p[j] for j in idx])
        order.append(idx)
        heap.append((sums[i][k - 1] - sums[i][0], i))
    heapq.heapify(heap)
    child: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        a = heapq.heappop(heap)[1]
        b = heapq.heappop(heap)[1]
        sa, sb = sums[a], sums[b]
        total = [sa[j] + sb[k - 1 - j] for j in range(k)]
        idx = sorted(range(k), key=lambda j: (-total[j], j))
        sums[a] = sums[b] = []
        sums.append(s := [total[j] for j in idx])
        child.append((a, b, idx))
        heapq.heappush(heap, (s[k - 1] - s[0], len(sums) - 1))
    place: list[list[int] | None] = [None] * len(sums)
    place[-1] = list(range(k))  # sorted place of a node -> final subset
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, idx = child[node - n]
        pa, pb = [0] * k, [0] * k
        for at, j in enumerate(idx):
            pa[j] = pb[k - 1 - j] = place[node][at]
        place[a], place[b], place[node] = pa, pb, None
    out = []
    for i in range(n):
        own = [0] * k
        for at, j in enumerate(order[i]):
            own[j] = place[i][at]
        out.append(own)
    return out


def _groups(k: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gsize", "key"], ascending=[False, True], kind="mergesort")
        got = difference([[int(x)] for x in pdf["gsize"]], k)
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "part": [x[0] for x in got], "gsize": pdf["gsize"].to_numpy()})

    return place


def _parts(k: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.pivot_table(index="bucket", columns="part", values="psum", aggfunc="sum", fill_value=0).reindex(columns=range(k), fill_value=0).sort_index()
        got = difference([[int(x) for x in r] for r in rows.to_numpy()], k)
        up = int(pdf["up"].iloc[0])
        return pd.DataFrame([(int(b), j, up, got[i][j], int(rows.iat[i, j])) for i, b in enumerate(rows.index) for j in range(k)], columns=["bucket", "part", "up", "up_part", "psum"])

    return place


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bucket_groups: int = 20_000, fan_in: int = 512, seed: int = 17) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``shard``, ``slot``.

    Documents with equal texts stay together. Groups are hashed into buckets of about ``bucket_groups``; each
    bucket is partitioned by k-way Karmarkar-Karp in one task, and the resulting partial partitions (k sums
    each) are themselves combined by differencing, ``fan_in`` at a time, until one is left. No task and no
    driver ever holds all groups.

    Null text: size 1, crc32 null, one group of its own; empty text: size 1, crc32 0. Repeated rows each get a
    slot. An empty table gives an empty result. Extra columns are ignored.
    """
    base = docs.select(
        F.col(id_col).alias(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(F.col(text_col).cast("binary"))), F.lit(b"")).alias("key"),
    )
    base = materialize(base, "shard-base")
    groups = materialize(base.groupBy("key").agg(F.sum("size").alias("gsize")), "shard-groups")
    n = max(1, -(-groups.count() // bucket_groups))
    placed = groups.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n))).groupBy("bucket").applyInPandas(_groups(n_shards), "key binary, bucket long, part int, gsize long")
    placed = materialize(placed, "shard-placed")
    level = placed.groupBy("bucket", "part").agg(F.sum("gsize").alias("psum"))
    maps = []
    while n > 1:
        step = level.withColumn("up", F.floor(F.col("bucket") / fan_in).cast("long")).groupBy("up").applyInPandas(_parts(n_shards), "bucket long, part int, up long, up_part int, psum long")
        step = materialize(step, "shard-level")
        maps.append(step.select("bucket", "part", "up", "up_part"))
        level = step.groupBy(F.col("up").alias("bucket"), F.col("up_part").alias("part")).agg(F.sum("psum").alias("psum"))
        n = -(-n // fan_in)
    where = placed.select("key", "bucket", "part")
    for m in maps:
        where = where.join(m, ["bucket", "part"]).select("key", F.col("up").alias("bucket"), F.col("up_part").alias("part"))
    out = base.join(where.select("key", F.col("part").alias("shard")), "key").drop("key")
    out = numbered(out, ["shard"], [id_col, "text_crc32"], "slot", seed)
    return out.select(id_col, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(placed: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as ``path/shard=K/`` Parquet folders, rows in slot order within each file.

    ``placed`` is the result of ``shard_by_bytes`` over ``docs``. A document and its place meet by id, size and crc32
    of the text, and by their number among the rows that agree in those, so rows repeated, without an id, or with
    one id and several texts are each written once. Texts that agree in all three are dealt in the order of their
    hash; a folder may then hold the other one's place, never a row too many or too few."""
    key = ["__id", "__size", "__crc"]
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    own = docs.withColumns({"__id": F.col(id_col), "__size": size, "__crc": F.crc32(F.col(text_col).cast("binary"))})
    own = own.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(text_col))))
    to = placed.select(F.col(id_col).alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    to = to.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__shard", "__slot"))).select(*[F.col(c).alias(f"{c}_to") for c in (*key, "__n")], F.col("__shard").alias("shard"), "__slot")
    on = [F.col(c).eqNullSafe(F.col(f"{c}_to")) for c in (*key, "__n")]
    rows = own.drop("shard").join(to, reduce(lambda a, b: a & b, on))
    rows = rows.repartition("shard", F.pmod(F.floor(F.col("__slot") / 100_000), F.lit(1024))).sortWithinPartitions("shard", "__slot")
    rows.select(*[c for c in docs.columns if c != "shard"], "shard").write.partitionBy("shard").parquet(path)
