"""Exact Jaccard self-join of word-shingle sets with PartEnum signatures, and its connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.common import discard, materialize
from eventspark.llm.components import connected_components

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_U30, _U27, _U31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U30)) * _M1
    x = (x ^ (x >> _U27)) * _M2
    return x ^ (x >> _U31)


class _Words(dict):
    """Hash of each word, kept until ``most`` words are known."""

    most = 200_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_POWERS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(256)]


def shingle_set(words: list[bytes], k: int, memo: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=n)
    m = min(n, k)
    out = np.full(n - m + 1, m * 0x632BE59BD9B4E019 & (1 << 64) - 1, dtype=np.uint64)
    for j in range(m):
        out += h[j : n - m + 1 + j] * np.uint64(_POWERS[j])
    return np.unique(mix(out))


class PartEnum:
    """Signatures such that any two sets with Jaccard similarity of ``num/den`` or more share one.

    Sizes fall into bands; a set takes part in the instance of its own band and, if a similar set could lie in the
    next band, in that one's. In an instance the symmetric difference of two similar sets is at most k, a function
    of the band. The 64-bit feature domain is cut into partitions of equal width:

    * k <= 2: k + 4 partitions, and a signature for every subset that leaves k of them out. One subset avoids all
      differences.
    * k > 2: k + 1 partitions and a signature for each that holds features: at most k partitions hold a
      difference. A similar pair could share no more than empty partitions only if both sets fill k partitions or
      fewer; such a set repeats the step over a rehashed domain, and after three rounds its empty partitions get
      signatures too. So no pair is lost, and no signature stands for emptiness in many sets.
    """

    def __init__(self, num: int = 4, den: int = 5) -> None:
        self.num, self.den = num, den
        self.low = [1]  # first size of each band
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 3 // 2, self.low[-1] * den // num + 1))

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of similar sets whose sizes add up to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return s
        band = int(np.searchsorted(self.low, n, side="right")) - 1
        mixed = mix(s)
        out = [self._instance(s, mixed, band)]
        if n * self.den >= self.num * self.low[band + 1]:
            out.append(self._instance(s, mixed, band + 1))
        return np.concatenate(out)

    def _instance(self, s: np.ndarray, mixed: np.ndarray, t: int) -> np.ndarray:
        n, top = len(s), self.low[t + 1] - 1
        k = self.most_apart(2 * top)
        if k <= 2:
            parts = k + 4
            own = ((s >> np.uint64(33)) * np.uint64(parts)) >> _U31
            sums = np.zeros(parts, dtype=np.uint64)
            np.add.at(sums, own.astype(np.int64), mixed)
            tags = [(i, sums[list(c)].sum(dtype=np.uint64)) for i, c in enumerate(combinations(range(parts), parts - k))]
            return mix(np.array([v for _, v in tags], dtype=np.uint64) ^ self._tag(t, 9, np.array([i for i, _ in tags])))
        k_own = self.most_apart(n + min(top, n * self.den // self.num))
        out = []
        for level in range(4):
            x = s if not level else np.sort(mix(s ^ np.uint64(level * 0x5851F42D4C957F2D & (1 << 64) - 1)))
            own = ((x >> np.uint64(33)) * np.uint64(k + 1)) >> _U31
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sums = np.add.reduceat(mix(x) if level else mixed, at)
            out.append(mix(sums ^ self._tag(t, level, own[at].astype(np.int64))))
            if len(at) > k_own:
                return np.concatenate(out) if level else out[0]
        empty = np.setdiff1d(np.arange(k + 1), own[at].astype(np.int64))
        out.append(mix(self._tag(t, 8, empty)))
        return np.concatenate(out)

    @staticmethod
    def _tag(t: int, level: int, j: np.ndarray) -> np.ndarray:
        return mix((np.asarray(j).astype(np.uint64) << np.uint64(16)) + np.uint64(t * 16 + level + 1))


def _words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


_SIGNED = pa.schema([("sig", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])
_ROWS = "sig long, doc long, n long, sketch array<long>"
def sketch(s: np.ndarray, least: int = 1024) -> np.ndarray:
    """Parity of the set's features by places, 64 to an integer: two sets differ by at least as many features as
    places. There are ``least`` places, or a power of two of at least the set's size, so that the sketch of a long
    text doesn't fill up; of sketches of two widths the wider one is folded to the narrower (xor of its parts)."""
    places = 1 << max(least - 1, len(s) - 1).bit_length()
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _batch(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Signature rows. Their sketch is empty, not null: Spark writes a null list to Arrow in time that grows with its
    place in the batch."""
    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(doc) + 1, dtype=np.int32)), pa.array([], pa.int64()))
    return pa.record_batch([pa.array(sig.astype(np.int64, copy=False)), pa.array(doc), pa.array(np.full(len(doc), -1, dtype=np.int64)), none], schema=_SIGNED)
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _sign(k: int, num: int, den: int, most_seen: int = 100_000):
    """(id, text) -> a row per signature of each set (n = -1), and a row per document with its node, set size and
    sketch (sig = node). A text whose words the task has met before gets the earlier document's node, and neither
    signatures nor a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, scheme, seen = _Words(), PartEnum(num, den), {}
        for batch in batches:
            sig, doc, held = [], [], 0
            nodes, sizes, sketches = [], [], []
            ids = batch.column(0).to_pylist()
            for i, own_text in zip(ids, batch.column(1), strict=True):  # one text at a time as a Python string
                text = own_text.as_py()
                words = _words_of(text) if text else []
                key = xxhash.xxh3_128_digest(b" ".join(words))
                node, n = seen.get(key, (None, None)) if words and i is not None else (None, None)
                made: np.ndarray | list = []
                if node is None:
                    s = shingle_set(words, k, memo)
                    node, n = i, len(s)
                    if n and i is not None:
                        x = scheme.signatures(s)
                        sig.append(x.view(np.int64))
                        doc.append(np.full(len(x), i, dtype=np.int64))
                        held += len(x)
                        made = sketch(s)
                        if len(seen) >= most_seen:
                            seen.clear()
                        seen[key] = (i, n)
                nodes.append(node)
                sizes.append(n)
                sketches.append(made)
                if held > 500_000:
                    yield _batch(np.concatenate(sig), np.concatenate(doc))
                    sig, doc, held = [], [], 0
            if sig:
                yield _batch(np.concatenate(sig), np.concatenate(doc))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], schema=_SIGNED)

    return run


def _shared(batches: Iterator[pa.RecordBatch], most_run: int = 4096, most_seen: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and document: for each signature of two documents or more a bucket with its
    documents (n = -1), and all document rows. Signatures with the same documents make one bucket, named after
    them, which a task gives out once. A signature with more than ``most_run`` documents streams through as a bucket
    of its own, so no group is held."""
    seen: set[int] = set()
    held_sig, held_doc = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    big: int | None = None  # the signature that streams through

    def rows(bucket: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        return _batch(bucket, doc)

    def name(sig: int) -> int:
        return int(mix(np.array([sig], dtype=np.int64).view(np.uint64)).view(np.int64)[0])

    def whole(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch | None:
        """The new buckets among complete runs."""
        at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(at, len(sig)))
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return None
        doc, size = doc[keep], size[size > 1]
        at = np.cumsum(size) - size
        bucket = mix(np.add.reduceat(mix(doc.view(np.uint64)), at) + size.astype(np.uint64))
        _, index = np.unique(bucket, return_index=True)
        new = np.array([i for i, v in zip(index.tolist(), bucket[index].tolist(), strict=True) if v not in seen], dtype=np.int64)
        if not len(new):
            return None
        if len(seen) + len(new) > most_seen:
            seen.clear()
        seen.update(bucket[new].tolist())
        pick = np.zeros(len(size), dtype=bool)
        pick[new] = True
        pick = np.repeat(pick, size)
        return rows(np.repeat(bucket, size)[pick].view(np.int64), doc[pick])

    for batch in batches:
        n = batch.column(2).to_numpy(zero_copy_only=False)
        is_doc = ~(n == -1)
        if is_doc.any():
            yield batch.filter(pa.array(is_doc))
            batch = batch.filter(pa.array(~is_doc))
        if not batch.num_rows:
            continue
        sig, doc = np.concatenate((held_sig, batch.column(0).to_numpy())), np.concatenate((held_doc, batch.column(1).to_numpy()))
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])))
        sig, doc = sig[new], doc[new]
        if big is not None:
            end = int(np.searchsorted(sig, big, side="right"))
            if end:
                yield rows(np.full(end, name(big)), doc[:end])
                sig, doc = sig[end:], doc[end:]
            if not len(sig):
                held_sig, held_doc = sig, doc
                continue
            big = None
        last = int(np.searchsorted(sig, sig[-1], side="left"))
        if last and (got := whole(sig[:last], doc[:last])):
            yield got
        held_sig, held_doc = sig[last:], doc[last:]
        if len(held_sig) > most_run:
            big = int(held_sig[0])
            yield rows(np.full(len(held_sig), name(big)), held_doc)
            held_sig, held_doc = held_sig[:0], held_doc[:0]
    if len(held_sig) and (got := whole(held_sig, held_doc)):
        yield got


def _verify(k: int, num: int, den: int):
    """Of rows (hub, salt, doc, text) sorted so that the hub's own texts come first: links of the hub. An id with
    several texts is one node, and linked by any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, at, hubs = _Words(), None, []
        for batch in batches:
            u, v = [], []
            for h, salt, doc, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                own = (h, salt)
                if own != at:
                    at, hubs = own, []
                s = shingle_set(_words_of(text.as_py()), k, memo)
                if doc == h:
                    if len(s) and not any(np.array_equal(s, x) for x in hubs):
                        hubs.append(s)
                    continue
                for hub in hubs:
                    if min(len(s), len(hub)) * den < max(len(s), len(hub)) * num:
                        continue
                    both = len(np.intersect1d(s, hub, assume_unique=True))
                    if both * den >= (len(s) + len(hub) - both) * num:
                        u.append(h)
                        v.append(doc)
                        break
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_LINKS)

    return run


def _might_hold(bits: np.ndarray):
    """Rows whose id may be in the set behind a bitmap (no id of the set is lost)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bits.value
        size = np.uint64(len(own) * 8)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            at = mix(batch.column(0).to_numpy().view(np.uint64)) % size
            yield batch.filter(pa.array((own[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))

    return run


def _mark(size: int):
    """Places of ids in a bitmap of ``size`` bits, each once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype=bool)
        for batch in batches:
            own[(mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(size)).astype(np.int64)] = True
        yield pa.record_batch([pa.array(np.flatnonzero(own))], names=["at"])

    return run


def _texts_of(base: DataFrame, ids: DataFrame, most_bits: int = 1 << 25) -> DataFrame:
    """(doc, text) of the ids. Before the join a bitmap of at most ``most_bits`` bits (4 MB) thins the texts, so that
    those of other documents are not shuffled; for too many ids it is left out."""
    spark = base.sparkSession
    texts = base.where("id is not null and text is not null")
    n = ids.count()
    size = 1 << max(12, (16 * n).bit_length())
    if size <= most_bits:
        at = ids.mapInArrow(_mark(size), "at long").distinct().toArrow().column("at").to_numpy()
        bits = np.zeros(size, dtype=np.uint8)
        bits[at] = 1
        shared = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
        texts = texts.mapInArrow(_might_hold(shared), "id long, text string")
    return texts.join(ids.select(F.col("doc").alias("id")), "id", "left_semi").select(F.col("id").alias("doc"), "text")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of differing parity of all rows of two blocks of sketches; the wider ones are folded."""
    w = min(a.shape[1], b.shape[1])
    a, b = (np.bitwise_xor.reduce(x.reshape(len(x), -1, w), axis=1) for x in (a, b))
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for i in range(w):
        out += np.bitwise_count(a[:, i][:, None] ^ b[:, i][None, :])
    return out


class _Side:
    """Rows of a bucket by size and id, with their sketches by width."""

    def __init__(self, doc: np.ndarray, comp: np.ndarray, size: np.ndarray, bits: list[np.ndarray]) -> None:
        order = np.lexsort((doc, size))
        self.doc, self.comp, self.size = doc[order], comp[order], size[order]
        width = np.array([len(bits[i]) for i in order])
        # Sizes and widths rise together: a block of one width is a slice.
        self.cuts = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), len(order)]
        self.bits = [np.stack([bits[i] for i in order[lo:hi]]).view(np.uint64) for lo, hi in zip(self.cuts, self.cuts[1:], strict=False)]

    def blocks(self, rows: int, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, end, sketches) of blocks of at most ``rows`` rows of one width within [lo, hi)."""
        hi = len(self.doc) if hi is None else hi
        for first, end, bits in zip(self.cuts, self.cuts[1:], self.bits, strict=False):
            for at in range(max(first, lo), min(end, hi), rows):
                to = min(at + rows, end, hi)
                yield at, to, bits[at - first : to - first]


def _pairs(num: int, den: int, block: int = 256, wide: int = 4096):
    """Of rows (sig, lo, hi, chunk, doc, comp, n, sketch) sorted by tile (sig, lo, hi): pairs of different components
    that size and sketch allow to be similar. A tile holds one chunk of a bucket, compared within itself, or two,
    compared with each other."""

    def meet(x: _Side, y: _Side) -> Iterator[pa.RecordBatch]:
        for lo, hi, a in x.blocks(block):
            start = int(np.searchsorted(y.size, -(-int(x.size[lo]) * num // den), side="left"))
            last = int(np.searchsorted(y.size, int(x.size[hi - 1]) * den // num, side="right"))
            for first, end, b in y.blocks(wide, max(start, lo if x is y else 0), last):
                p, q = x.size[lo:hi][:, None], y.size[first:end][None, :]
                ok = (x.comp[lo:hi][:, None] != y.comp[first:end][None, :]) & (np.minimum(p, q) * den >= np.maximum(p, q) * num)
                if x is y:
                    ok &= np.arange(lo, hi)[:, None] < np.arange(first, end)[None, :]
                if not ok.any():
                    continue
                i, j = np.nonzero(ok & (_apart(a, b) * (num + den) <= (p + q) * (den - num)))
                if len(i):
                    u, v = x.doc[lo + i], y.doc[first + j]
                    yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=_LINKS)

    def tile(rows: list[tuple[np.ndarray, ...]], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        chunk, doc, comp, size = (np.concatenate([r[i] for r in rows]) for i in range(4))
        bits = [b for r in rows for b in r[4]]
        sides = []
        for c in sorted({lo, hi}):
            at = np.flatnonzero(chunk == c)
            if not len(at):
                return
            sides.append(_Side(doc[at], comp[at], size[at], [bits[i] for i in at]))
        yield from meet(sides[0], sides[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, lo, hi, chunk, doc, comp, size = (c.to_numpy() for c in batch.columns[:7])
            words, ends = batch.column(7).values.to_numpy(), batch.column(7).offsets.to_numpy()
            cuts = np.flatnonzero((sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sig)], strict=True):
                own = (int(sig[first]), int(lo[first]), int(hi[first]))
                if own != at:
                    if held:
                        yield from tile(held, *at[1:])
                    at, held = own, []
                held.append((chunk[first:end].copy(), doc[first:end].copy(), comp[first:end].copy(), size[first:end].copy(), [words[ends[i] : ends[i + 1]].copy() for i in range(first, end)]))
        if held:
            yield from tile(held, *at[1:])

    return run


_TILED = "sig long, lo long, hi long, chunk long, doc long, comp long, n long, sketch array<long>"


def _tiles(rows: DataFrame, most: int) -> DataFrame:
    """Rows (sig, doc, comp, n, sketch) dealt into tiles, so that no task holds a bucket of more than ``most`` rows:
    such a bucket is cut into chunks, and each pair of chunks is a tile."""
    big = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select(F.col("sig").alias("b_sig"), F.ceil(F.col("c") / most).cast("long").alias("s"))
    own = rows.join(big, F.col("sig") == F.col("b_sig"), "left").withColumn("s", F.coalesce("s", F.lit(1)))
    own = own.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("s")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))
    own = own.select("*", other.alias("o")).select("sig", F.least("chunk", "o").alias("lo"), F.greatest("chunk", "o").alias("hi"), "chunk", "doc", "comp", "n", "sketch")
    return own.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")


def _folded(sketch: str, to: str):
    """The sketch folded to the width of another one, if that is narrower."""
    w = F.size(to)
    part = lambda i: F.aggregate(F.sequence(F.lit(1), F.expr(f"int(size({sketch}) / size({to})) - 1")), F.get(sketch, i), lambda x, j: x.bitwiseXOR(F.get(sketch, j * w + i)))
    return F.when(F.size(sketch) > w, F.transform(F.sequence(F.lit(0), w - 1), part)).otherwise(F.col(sketch))


def _near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The (hub, doc) pairs that sizes and sketches allow to be similar."""
    for side in ("hub", "doc"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    sized = F.least("n_hub", "n_doc") * den >= F.greatest("n_hub", "n_doc") * num
    apart = F.aggregate(F.zip_with(_folded("s_hub", "s_doc"), _folded("s_doc", "s_hub"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    total = F.col("n_hub") + F.col("n_doc")
    return pairs.where(sized).where(apart * (num + den) <= total * (den - num)).select("hub", "doc")


def _checked(stars: DataFrame, base: DataFrame, k: int, num: int, den: int, most: int = 2000) -> DataFrame:
    """The links among distinct (hub, doc) pairs. A hub with many documents is dealt over several tasks."""
    stars = materialize(stars.distinct(), "join-stars")
    ids = stars.select("doc").union(stars.select(F.col("hub").alias("doc"))).distinct()
    texts = _texts_of(base, ids)
    spread = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("s"))
    leaves = stars.join(spread, "hub").select("hub", F.pmod(F.xxhash64("doc"), F.col("s")).cast("int").alias("salt"), "doc")
    hubs = spread.select("hub", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.col("hub").alias("doc"))
    rows = leaves.unionByName(hubs).join(texts, "doc").select("hub", "salt", "doc", "text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", (F.col("doc") != F.col("hub")).cast("int"), "doc")
    links = materialize(rows.mapInArrow(_verify(k, num, den), "u long, v long").distinct(), "join-links")
    discard(stars)
    return links


def join_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = 20_000) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``: the smallest id reachable by links.

    Two documents link when the Jaccard similarity of their sets of distinct k-word shingles is ``num/den`` or
    more; A-Z is lower-cased. A text of fewer than k words is one shingle; null, empty and word-less texts have an
    empty set and link with nothing, as do rows without an id. Very long texts are joined whole. Rows with one id are
    one node, repeated or with different texts: any of its texts links it. Other columns are ignored, an empty table
    gives an empty result.

    1. PartEnum signatures and a sketch of every text (texts that a task meets again only point to the first).
    2. One shuffle by signature. Signatures that two documents or more have become buckets; those with the same
       documents are one bucket.
    3. In each bucket, the document of the most buckets is the hub. Others are compared with it: by size and by a
       lower bound on the difference from the sketches, then exactly. Components of the found links follow.
    4. Documents of one bucket but still different components are compared all with all in the same way, in blocks; a
       bucket of more than ``tile_rows`` documents is cut into chunks, and each pair of chunks is a task's work.

    Pairs inside a component are never expanded, and every pair of different components that shares a signature is
    decided exactly, so the components are those of all links. The sizes ``most_seen``, ``most_run`` and ``most_bits``
    of the helpers bound memory only: beyond them a task repeats work or skips a thinning step, and loses no link.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = base.mapInArrow(_sign(k, num, den), _ROWS).repartition("sig").sortWithinPartitions("sig", "doc")
    found = materialize(signed.mapInArrow(_shared, _ROWS), "join-shared")
    members = found.where("n <> -1").select(F.col("sig").alias("node"), F.col("doc").alias("id"), "n")
    sketches = found.where("n > 0 and size(sketch) > 0").groupBy(F.col("sig").alias("node"), "n", F.xxhash64("sketch").alias("same")).agg(F.first("sketch").alias("sketch")).drop("same")
    shared = materialize(found.where("n = -1").select("sig", "doc").distinct(), "join-buckets")

    rank = shared.groupBy("doc").agg(F.count(F.lit(1)).alias("w"))
    hubs = shared.join(rank, "doc").groupBy("sig").agg(F.max_by("doc", "w").alias("hub"))
    stars = shared.join(hubs, "sig").where("doc <> hub").select("hub", "doc").distinct()
    links = _checked(_near(stars, sketches, num, den), base, k, num, den)
    # An id with several texts can have one node of its own and others of the texts' first copies.
    several = members.groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").drop("hi")
    links = links.unionByName(materialize(members.join(several, "id").select(F.col("node").alias("u"), F.col("lo").alias("v")), "join-ids"))
    comps = materialize(connected_components(links), "join-comps")

    rest = shared.join(comps, F.col("doc") == F.col("node"), "left").select("sig", "doc", F.coalesce("comp", "doc").alias("comp"))
    mixed = rest.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    rows = rest.join(mixed, "sig", "left_semi").join(sketches, F.col("doc") == F.col("node")).select("sig", "doc", "comp", "n", "sketch")
    pairs = _tiles(rows, tile_rows).mapInArrow(_pairs(num, den), "u long, v long")
    more = _checked(pairs.select(F.col("u").alias("hub"), F.col("v").alias("doc")).distinct(), base, k, num, den)
    if not more.isEmpty():
        comps = materialize(connected_components(links.unionByName(more)), "join-comps")
    discard(shared, more)

    # The node of a document is its first copy in a task, not always the smallest id of the class.
    nodes = members.join(comps.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").select("id", "n", F.coalesce("comp", "node").alias("root"))
    least = nodes.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    out = nodes.join(least.withColumnRenamed("root", "l_root"), F.col("root") == F.col("l_root"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
