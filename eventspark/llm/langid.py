"""Language identification: family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventspark.llm.common import bound_batches, discard, materialize

# Families of common language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
UND = "und"


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"={lang}")


def _letter_table() -> np.ndarray:
    """Code point below U+10000 -> its lower-case letter, or a space for what is no letter."""
    out = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Lower-cased letters as code points with single spaces for runs of anything else, and a space at either end.
    Without a letter: empty."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _LETTERS[np.minimum(raw, 0xFFFF)]
    if raw.size and raw.max() > 0xFFFF:
        far = np.flatnonzero(raw > 0xFFFF)
        c[far] = [ord(low) if len(low := x.lower()) == 1 and x.isalpha() else (v if x.isalpha() else 32) for v in raw[far].tolist() for x in (chr(v),)]
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    keep = np.ones(c.size, dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    return c if c.size > 1 else c[:0]


def features(c: np.ndarray, dim: int) -> np.ndarray:
    """Square roots of hashed counts of 1- to 3-letter grams, of length 1."""
    mask = np.uint32(dim - 1)
    one, two, three = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
    a = c * one
    counts = np.bincount((a >> np.uint32(15)) & mask, minlength=dim)
    if c.size > 1:
        b = (a[:-1] ^ (c[1:] * two)) * three
        counts += np.bincount((b >> np.uint32(15)) & mask, minlength=dim)
    if c.size > 2:
        t = (b[:-1] ^ (c[2:] * one)) * two
        counts += np.bincount((t >> np.uint32(15)) & mask, minlength=dim)
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def sparse(c: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of the features that are not 0."""
    x = features(c, dim)
    at = np.flatnonzero(x)
    return at.astype(np.uint16), x[at]


class SparseRows:
    """Rows of ``dim`` columns by their places and values other than 0, all rows in one piece each; ``ends`` is where
    each row's part ends, and no row is empty. Few columns are multiplied by places alone; for many, blocks of ``most``
    rows at a time are dense, so that the fit's memory is that of the values."""

    FEW = 6

    def __init__(self, at: np.ndarray, value: np.ndarray, ends: np.ndarray, dim: int, most: int = 128) -> None:
        self.dim, self.most, self.at, self.value = dim, most, at.astype(np.intp), value
        self.starts = np.concatenate(([0], ends)).astype(np.int64)
        row = np.repeat(np.arange(len(ends)), np.diff(self.starts))
        by_place = np.argsort(at, kind="stable")
        self.row_of, self.value_of = row[by_place], value[by_place]
        self.places, self.begin = np.unique(at[by_place], return_index=True)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def products(self, v: np.ndarray, pull) -> tuple[np.ndarray, np.ndarray]:
        """Of all rows X: p = ``pull(first, end, X v)`` gives (X' p, sum of p)."""
        if v.shape[1] > self.FEW:
            out, total = np.zeros_like(v), np.zeros(v.shape[1], dtype=np.float32)
            for lo, hi, rows in self.blocks():
                p = pull(lo, hi, rows @ v)
                out += rows.T @ p
                total += p.sum(axis=0)
            return out, total
        x = np.stack([np.add.reduceat(self.value * c[self.at], self.starts[:-1]) for c in v.T], axis=1)
        p, out = pull(0, len(self), x), np.zeros_like(v)
        for i, c in enumerate(np.ascontiguousarray(p.T)):
            out[self.places, i] = np.add.reduceat(self.value_of * c[self.row_of], self.begin)
        return out, p.sum(axis=0)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, end, dense rows) of block after block; they share one array."""
        dense = np.zeros((min(self.most, len(self)), self.dim), dtype=np.float32)
        for lo in range(0, len(self), self.most):
            hi = min(lo + self.most, len(self))
            own = slice(self.starts[lo], self.starts[hi])
            row = np.repeat(np.arange(hi - lo), np.diff(self.starts[lo : hi + 1]))
            dense[row, self.at[own]] = self.value[own]
            yield lo, hi, dense[: hi - lo]
            dense[row, self.at[own]] = 0


def fit_svms(x: SparseRows, y: np.ndarray, l2: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Linear SVMs (squared hinge) of all columns of ``y`` at once, by accelerated gradient descent; the last weight of
    each row of the result is the bias. y is -1 or 1, or 0 where a row takes no part, so that no problem needs a copy
    of its rows."""
    d, k = x.dim, y.shape[1]
    w, v = np.zeros((d + 1, k), dtype=np.float32), np.zeros((d + 1, k), dtype=np.float32)
    weight = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(axis=0)), np.where(y < 0, 0.5 / np.maximum(1, (y < 0).sum(axis=0)), 0)).astype(np.float32)
    rate = np.float32(1.0 / (4.0 + l2))  # rows have length 1 and a bias of 1: the loss has curvature 4 at most
    for t in range(steps):
        def pull(lo: int, hi: int, x: np.ndarray, bias=v[d]) -> np.ndarray:
            return weight[lo:hi] * y[lo:hi] * np.maximum(0, 1 - y[lo:hi] * (x + bias))

        g = np.float32(l2) * v
        slope, total = x.products(v[:d], pull)
        g[:d] -= 2 * slope
        g[d] = -2 * total
        new = v - rate * g
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return np.ascontiguousarray(w.T)


@dataclass
class LanguageModel:
    """``fam``: one-versus-rest weights by family. ``pairs``: weights by (first, second) language of a family."""

    dim: int
    members: dict[str, list[str]]
    fam: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]
    scale: float = 4.0

    def __post_init__(self) -> None:
        self.names = sorted(self.members)
        self.keys = sorted(self.pairs)
        rows = [self.fam[f] for f in self.names if f in self.fam] + [self.pairs[k] for k in self.keys]
        self.stack = np.stack(rows) if rows else np.zeros((0, self.dim + 1), dtype=np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        c = letters(text) if text else ()
        if not len(c) or not self.members:
            return UND, 0.0
        m = self.stack[:, :-1] @ features(np.asarray(c), self.dim) + self.stack[:, -1]
        nf = len(self.fam)
        if nf:
            ranked = np.argsort(-m[:nf], kind="stable")
            name = self.names[ranked[0]]
            sure = _sigmoid(self.scale * (m[ranked[0]] - m[ranked[1]]) / 2)
        else:
            name, sure = self.names[0], 1.0
        langs = self.members[name]
        if len(langs) == 1:
            return langs[0], sure
        margin = {k: float(v) for k, v in zip(self.keys, m[nf:], strict=True)}
        votes = {x: [0, 0.0] for x in langs}
        for a, b in combinations(langs, 2):
            v = margin[a, b]
            votes[a if v >= 0 else b][0] += 1
            votes[a][1] += v
            votes[b][1] -= v
        best, second = sorted(langs, key=lambda x: (-votes[x][0], -votes[x][1], x))[:2]
        v = margin[min(best, second), max(best, second)] * (1 if best < second else -1)
        return best, float(min(sure, _sigmoid(self.scale * max(v, 0.0))))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(float(x), -40.0), 40.0))))


def train(texts: list[str], langs: list[str], dim: int = 8192, steps: int = 120) -> LanguageModel:
    kept = [(sparse(c, dim), lang) for t, lang in zip(texts, langs, strict=True) if t and (c := letters(t)).size]
    if not kept:
        return LanguageModel(dim, {}, {}, {})
    at, value = (np.concatenate([k[0][i] for k in kept]) for i in range(2))
    return _train(SparseRows(at, value, np.cumsum([len(k[0][0]) for k in kept]), dim), [k[1] for k in kept], steps)


def _members(langs: list[str]) -> dict[str, list[str]]:
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(family(lang), []).append(lang)
    return members


def _train(x: SparseRows, langs: list[str], steps: int = 120) -> LanguageModel:
    members = _members(langs)
    fams = sorted(members) if len(members) > 1 else []
    pairs = [p for f in members.values() for p in combinations(f, 2)]
    if not fams and not pairs:
        return LanguageModel(x.dim, members, {}, {})
    w = fit_svms(x, np.concatenate([_rest(langs, fams), _against(langs, pairs)], axis=1), steps=steps)
    return LanguageModel(x.dim, members, dict(zip(fams, w[: len(fams)], strict=True)), dict(zip(pairs, w[len(fams) :], strict=True)))


def _rest(langs: list[str], fams: list[str]) -> np.ndarray:
    """A column for each family: 1 for its rows, -1 for all others."""
    of = np.array([family(v) for v in langs], dtype=object)
    return np.where(of[:, None] == np.array(fams, dtype=object)[None, :], 1, -1).astype(np.float32) if fams else np.zeros((len(langs), 0), dtype=np.float32)


def _against(langs: list[str], pairs: list[tuple[str, str]]) -> np.ndarray:
    """A column for each pair of languages: 1, -1, and 0 for the rows of others."""
    own = np.array(langs, dtype=object)
    return np.stack([np.where(own == a, 1, np.where(own == b, -1, 0)) for a, b in pairs], axis=1).astype(np.float32) if pairs else np.zeros((len(langs), 0), dtype=np.float32)


def _fit_apart(sample: DataFrame, langs: list[str], dim: int, steps: int = 120, together: int = 32) -> LanguageModel:
    """The model of ``sample`` (l, h, at, value), fitted by the executors: ``together`` families against all rows in a
    task, each pair of languages against the rows of the two. Only weights come to the driver."""
    members = _members(langs)
    fams = sorted(members) if len(members) > 1 else []
    both = fams if len(fams) == 2 else []  # one against the rest is the other's negative
    fams = fams[: len(fams) - len(both) // 2]
    pairs = [p for f in members.values() for p in combinations(f, 2)]
    tasks: list[list] = [fams[i : i + together] for i in range(0, len(fams), together)]
    n_rest = len(tasks)
    tasks += [[p] for p in pairs]
    if not tasks:
        return LanguageModel(dim, members, {}, {})
    parts = []
    if n_rest:
        parts.append(sample.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(n_rest - 1)))))
    if pairs:
        of = sample.sparkSession.createDataFrame([(lang, n_rest + i) for i, p in enumerate(pairs) for lang in p], "of string, task int")
        parts.append(sample.join(of, F.col("l") == F.col("of")).drop("of"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["l", "h"], kind="stable")
        task, own = int(pdf["task"].iloc[0]), pdf["l"].tolist()
        at = np.frombuffer(b"".join(pdf["at"]), dtype=np.uint16)
        value = np.frombuffer(b"".join(pdf["value"]), dtype=np.float32)
        x = SparseRows(at, value, np.cumsum(pdf["at"].map(len).to_numpy()) // 2, dim, most=512)
        w = fit_svms(x, _rest(own, tasks[task]) if task < n_rest else _against(own, tasks[task]), steps=steps)
        return pd.DataFrame({"task": task, "nth": np.arange(len(w)), "w": [r.tobytes() for r in w]})

    found = reduce(DataFrame.unionByName, parts).groupBy("task").applyInPandas(fit, "task int, nth int, w binary").collect()
    w = {tasks[r["task"]][r["nth"]]: np.frombuffer(r["w"], dtype=np.float32) for r in found}
    if both:
        w[both[1]] = -w[both[0]]
    return LanguageModel(dim, members, {f: w[f] for f in both or fams}, {p: w[p] for p in pairs})


def fit_languages(docs: DataFrame, learn_where, per_lang: int = 800, most: int = 8_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 8192, seed: int = 11) -> LanguageModel:
    """Fit on at most ``per_lang`` labelled documents of each language, and ``most`` in all (shared evenly), those with
    the smallest seeded hash of id and text.

    The bound is the only sampling: it holds at every corpus size and for any ids, texts are used whole, and every
    document is predicted. Rows with a null label or text teach nothing; rows repeated with id, text and label count
    once. Executors turn the texts into hashed gram counts and train the SVMs; the weights, at most ``most`` times
    ``dim`` numbers and those of pairs within a family, reach the driver. Any number of languages can be told apart;
    beyond ``most`` the rarest are not learned.
    """
    bound_batches(docs.sparkSession)
    rows = docs.where(learn_where).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t is not null")
    counts = {r["l"]: int(r["n"]) for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(most).collect()}
    if not counts:
        return LanguageModel(dim, {}, {}, {})
    each = max(1, min(per_lang, most // len(counts)))
    span = 1 << 62
    # Twice the expected share passes; the exact rank follows on those few rows. A row a language, ``most`` of them.
    limits = docs.sparkSession.createDataFrame([(lang, int(span * min(1.0, (2.0 * each + 40) / n))) for lang, n in counts.items()], "of string, limit long")
    few = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "i", "t"), F.lit(span))).join(F.broadcast(limits), F.col("l") == F.col("of"))
    few = few.where(F.col("h") <= F.col("limit")).groupBy("l", "h", "i").agg(F.first("t").alias("t"))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", F.col("i").cast("string")))).where(F.col("r") <= each)
    sample = materialize(ranked.select("l", "h", "t").mapInArrow(_grams(dim), "l string, h long, at binary, value binary"), "langid-sample")
    model = _fit_apart(sample, [r["l"] for r in sample.select("l").distinct().collect()], dim)
    discard(sample)
    return model


def _grams(dim: int):
    """(l, h, t) -> (l, h, places of the features, their values); texts without a letter give no row."""
    if dim > 1 << 16:
        raise ValueError("dim must be at most 65536")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, ats, values = [], [], []
            for i, t in enumerate(batch.column(2)):
                c = letters(t.as_py())
                if c.size:
                    at, value = sparse(c, dim)
                    keep.append(i)
                    ats.append(at.tobytes())
                    values.append(value.tobytes())
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([own.column(0), own.column(1), pa.array(ats, pa.binary()), pa.array(values, pa.binary())], names=["l", "h", "at", "value"])

    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: every whole text is predicted.

    Null, empty and letterless texts, and every text under a model that has seen no language, give ``und`` with
    score 0. Very long texts are predicted whole, a text at a time. Ties of votes go to the larger margin, then to the
    smaller code. Columns of those names in the input are replaced; other columns, repeated rows and order stay. An
    empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for s in batches:
            yield pd.DataFrame([own.predict(t if isinstance(t, str) else None) for t in s], columns=["lang_pred", "score"])

    out = docs.drop("lang_pred", "score").withColumn("__p", predict(F.col(text_col)))
    return out.select("*", "__p.lang_pred", "__p.score").drop("__p")
