"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

A document is cut into overlapping windows of words; every window of the whole text is scored and the highest
window decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventspark.llm.common import materialize

_WORD = re.compile(r"[^\W_]+")
_GRAMS = 2048  # buckets of hashed character trigrams


def tokens(text: str | None, longest: int = 32) -> list[str]:
    """Words; of a longer one (unspaced scripts, words run together) pieces of ``longest`` characters, each half
    over the next, so that no part of it goes unseen."""
    hop = longest // 2
    words = _WORD.findall(text.lower()) if text else []
    return [x for w in words for x in ((w,) if len(w) <= longest else (w[i : i + longest] for i in range(0, len(w) - hop, hop)))]


def trigrams(word: str) -> list[int]:
    """Buckets of the character trigrams of the whole word with its borders."""
    c = [ord(x) for x in f"<{word}>"]
    return [(a * 961 + b * 31 + d) * 40503 >> 4 & _GRAMS - 1 for a, b, d in zip(c, c[1:], c[2:], strict=False)] or [0]


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def window_index(n_tokens: list[int], width: int, hop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over concatenated documents: start and length of each window, and its document."""
    start, size, doc, base = [], [], [], 0
    for i, n in enumerate(n_tokens):
        if n:
            k = 1 if n <= width else 1 + -(-(n - width) // hop)
            s = np.minimum(np.arange(k) * hop, max(0, n - width))
            start.append(s + base)
            size.append(np.full(k, min(n, width)))
            doc.append(np.full(k, i))
        base += n
    if not start:
        return (np.zeros(0, dtype=np.int64),) * 3
    return np.concatenate(start), np.concatenate(size), np.concatenate(doc)


@dataclass
class GruModel:
    """Parameters ``p``; ``vocab`` maps a word to its row of the word embedding (row 0: any other word)."""

    vocab: dict[str, int]
    p: dict[str, np.ndarray]
    width: int = 32
    hop: int = 16
    a: float = 1.0
    b: float = 0.0
    _memo: dict[str, int] = field(default_factory=dict)
    _rows: int = 0
    _table: np.ndarray | None = None
    most_rows: int = 300_000

    def inputs(self, words: list[str]) -> np.ndarray:
        """Word and character inputs of words, one row each."""
        grams = [trigrams(w) for w in words]
        flat = np.fromiter((g for x in grams for g in x), dtype=np.int64)
        at = np.cumsum([0, *map(len, grams)])[:-1]
        chars = np.add.reduceat(self.p["chars"][flat], at, axis=0) / np.array([len(g) for g in grams], dtype=np.float32)[:, None] if words else np.zeros((0, self.p["chars"].shape[1]), dtype=np.float32)
        ids = np.array([self.vocab.get(w, 0) for w in words], dtype=np.int64)
        return np.concatenate((self.p["words"][ids], chars), axis=1).astype(np.float32)

    def rows_of(self, toks: list[str]) -> np.ndarray:
        """Rows of the table of gate inputs; new words get rows, and a full table starts anew."""
        new = [w for w in dict.fromkeys(toks) if w not in self._memo]
        if new:
            if self._table is None or self._rows + len(new) > self.most_rows:
                new = list(dict.fromkeys(toks))
                self._memo, self._rows = {}, 0
                self._table = np.zeros((max(len(new), 4096), 6 * self.p["uf"].shape[0]), dtype=np.float32)
            need = self._rows + len(new)
            if need > len(self._table):
                self._table = np.concatenate((self._table, np.zeros((max(need, 2 * len(self._table)) - len(self._table), self._table.shape[1]), dtype=np.float32)))
            x = self.inputs(new)
            self._table[self._rows : need] = np.concatenate((x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]), axis=1)
            for i, w in enumerate(new):
                self._memo[w] = self._rows + i
            self._rows = need
        memo = self._memo
        return np.fromiter((memo[w] for w in toks), dtype=np.int64, count=len(toks))

    def logits(self, gates: np.ndarray, rows: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 2048) -> np.ndarray:
        out = np.zeros(len(start), dtype=np.float32)
        order = np.argsort(size, kind="stable")
        cuts = [*range(0, len(order), block), len(order)]
        full = int(np.searchsorted(size[order], self.width))
        for lo, hi in zip(cuts := sorted({*cuts, full}), cuts[1:], strict=False):
            at = order[lo:hi]
            t_most = int(size[at].max())
            idx = start[at] + np.minimum(np.arange(t_most)[:, None], size[at] - 1)
            out[at] = self._run(gates, rows[idx], size[at])
        return out

    def _run(self, gates: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """ids: (steps, windows) rows of ``gates``."""
        p, (steps, n) = self.p, ids.shape
        h = p["uf"].shape[0]
        states = np.empty((2, steps, n, h), dtype=np.float32)
        even = bool(size.min() == steps)
        half = gates.shape[1] // 2
        both = gates.reshape(-1, 2, half)
        r, zr, c = np.empty((n, 3 * h), dtype=np.float32), np.empty((n, 2 * h), dtype=np.float32), np.empty((n, h), dtype=np.float32)
        for way, u in ((0, p["uf"]), (1, p["ub"])):
            own = np.ascontiguousarray(both[:, way]) if len(gates) <= n else both[:, way]
            s = np.zeros((n, h), dtype=np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                g = own[ids[t]]
                np.matmul(s, u, out=r)
                np.add(g[:, : 2 * h], r[:, : 2 * h], out=zr)
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[:, h:], r[:, 2 * h :], out=c)
                c += g[:, 2 * h :]
                c *= -2
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                c -= s
                c *= zr[:, :h]
                if not even:
                    c *= (t < size)[:, None]
                new = states[way, t]
                np.add(s, c, out=new)
                s = new
        wa = p["wa"]
        e = states[0] @ wa[:h]
        e += states[1] @ wa[h:]
        e *= -2
        np.exp(e, out=e)
        e += 1
        np.divide(2, e, out=e)
        e -= 1
        e = e @ p["va"]
        if not even:
            e[np.arange(steps)[:, None] >= size] = -1e9
        e -= e.max(axis=0)
        w = np.exp(e, out=e)
        w /= w.sum(axis=0)
        value = states[0] @ p["wo"][:h]
        value += states[1] @ p["wo"][h:]
        value *= w
        return value.sum(axis=0) + p["bo"]

    def score(self, texts: list[str | None], most_tokens: int = 400_000) -> np.ndarray:
        """Probability of the toxic label of each text; texts without words get that of the lowest evidence."""
        out = np.full(len(texts), float(_sig(np.float64(self.b - 12.0 * self.a))))
        lo = 0
        while lo < len(texts):
            toks: list[str] = []
            counts: list[int] = []
            hi = lo
            while hi < len(texts) and (hi == lo or len(toks) < most_tokens):
                x = tokens(texts[hi])
                toks += x
                counts.append(len(x))
                hi += 1
            rows = self.rows_of(toks)
            start, size, doc = window_index(counts, self.width, self.hop)
            if len(start):
                best = np.full(hi - lo, -np.inf)
                np.maximum.at(best, doc, self.logits(self._table, rows, start, size))
                has = np.isfinite(best)
                out[lo:hi][has] = _sig(self.a * np.clip(best[has], -12, 30) + self.b)
            lo = hi
        return out

    def bare(self) -> GruModel:
        return GruModel(self.vocab, self.p, self.width, self.hop, self.a, self.b)


def _step(model: GruModel, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss, gradients of the network's parameters, and of its inputs x (steps, n, d). mask: (steps, n)."""
    p, (steps, n, _) = model.p, x.shape
    h = p["uf"].shape[0]
    states = np.zeros((steps, n, 2 * h), dtype=x.dtype)
    kept: dict[int, list] = {0: [], 1: []}
    for way, (w, u, b) in enumerate((("wf", "uf", "bf"), ("wb", "ub", "bb"))):
        s = np.zeros((n, h), dtype=x.dtype)
        g_all = x @ p[w] + p[b]
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            g, r, m = g_all[t], s @ p[u], mask[t][:, None]
            zr = _sig(g[:, : 2 * h] + r[:, : 2 * h])
            c = np.tanh(g[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
            kept[way].append((t, s, zr, c, r))
            s = s + m * zr[:, :h] * (c - s)
            states[t, :, way * h : (way + 1) * h] = s
    k = np.tanh(states @ p["wa"])
    e = np.where(mask > 0, k @ p["va"], -1e9)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    prob = _sig(pooled @ p["wo"] + p["bo"])
    loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
    d = ((prob - y) / n).astype(x.dtype)
    grad = {"wo": pooled.T @ d, "bo": d.sum()}
    dpool = d[:, None] * p["wo"]
    ds = a[:, :, None] * dpool
    da = np.einsum("tnh,nh->tn", states, dpool)
    de = a * (da - (a * da).sum(axis=0))
    grad["va"] = np.einsum("tnk,tn->k", k, de)
    dk = de[:, :, None] * p["va"] * (1 - k * k)
    grad["wa"] = np.einsum("tnh,tnk->hk", states, dk)
    ds = ds + dk @ p["wa"].T
    dx = np.zeros_like(x)
    for way, (w, u, b) in enumerate((("wf", "uf", "bf"), ("wb", "ub", "bb"))):
        dg = np.zeros((steps, n, 3 * h), dtype=x.dtype)
        du = np.zeros_like(p[u])
        back = np.zeros((n, h), dtype=x.dtype)
        for t, s, zr, c, r in reversed(kept[way]):
            m = mask[t][:, None]
            back = back + ds[t, :, way * h : (way + 1) * h]
            z, q = zr[:, :h], zr[:, h:]
            dc = back * m * z * (1 - c * c)
            dz = back * m * (c - s) * z * (1 - z)
            dq = dc * r[:, 2 * h :] * q * (1 - q)
            dr = np.concatenate((dz, dq, dc * q), axis=1)
            dg[t] = np.concatenate((dz, dq, dc), axis=1)
            du += s.T @ dr
            back = back * (1 - m * z) + dr @ p[u].T
        grad[u], grad[b] = du, dg.sum(axis=(0, 1))
        grad[w] = np.einsum("tnd,tng->dg", x, dg)
        dx += dg @ p[w].T
    return loss, grad, dx


def train(texts: list[str], labels: list[int], hidden: int = 8, d_word: int = 6, d_char: int = 6, width: int = 32, hop: int = 16, epochs: int = 3, batch: int = 256, least_steps: int = 120, least_docs: int = 3, windows_per_doc: int = 2, calm_share: float = 0.5, seed: int = 5) -> GruModel:
    """Learn from labelled documents. Words in ``least_docs`` documents or more have an embedding of their own,
    whose first component starts at the word's smoothed log-odds; all parameters are then trained through time on
    windows. Bounds of an epoch: each document teaches with its highest windows, ``windows_per_doc`` at most (of a toxic
    one those near its highest), and clean documents with random windows besides, ``calm_share`` times as many."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    docs = [tokens(t) for t in texts]
    sets = [set(d) for d in docs]
    df, tox = Counter(w for s in sets for w in s), Counter(w for s, v in zip(sets, y, strict=True) if v for w in s)
    n_pos, n_neg = float(y.sum()), float(len(y) - y.sum())
    words = sorted(w for w, n in df.items() if n >= least_docs)
    vocab = {w: i + 1 for i, w in enumerate(words)}
    d = d_word + d_char

    def init(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    p = {"words": (0.1 * rng.normal(size=(len(words) + 1, d_word))).astype(np.float32), "chars": (0.1 * rng.normal(size=(_GRAMS, d_char))).astype(np.float32)}
    p |= {"wf": init(d, 3 * hidden), "uf": init(hidden, 3 * hidden), "bf": np.zeros(3 * hidden, dtype=np.float32), "wb": init(d, 3 * hidden), "ub": init(hidden, 3 * hidden), "bb": np.zeros(3 * hidden, dtype=np.float32)}
    p |= {"wa": init(2 * hidden, hidden), "va": init(hidden), "wo": init(2 * hidden), "bo": np.float32(0)}
    odds = np.zeros(len(words) + 1, dtype=np.float32)
    for w, i in vocab.items():
        k = tox[w]
        lo = np.log((k + 0.5) / (n_pos + 1)) - np.log((df[w] - k + 0.5) / (n_neg + 1))
        z = lo / np.sqrt(1 / (k + 0.5) + 1 / (df[w] - k + 0.5))
        odds[i] = np.clip(lo, -3, 5) if abs(z) > 2.5 else 0
    p["words"][:, 0] = odds / 2
    model = GruModel(vocab, p, width, hop)
    batch = max(32, min(batch, len(docs) // 8))
    if not n_pos or not n_neg:
        model.a, model.b = 0.0, (8.0 if n_pos else -8.0)
        return model

    uniq = {w: i for i, w in enumerate(dict.fromkeys(w for x in docs for w in x))}
    names = list(uniq)
    ids = np.array([vocab.get(w, 0) for w in names], dtype=np.int64)
    longest = max((len(trigrams(w)) for w in names), default=1)
    grams = np.zeros((len(names), longest), dtype=np.int64)
    n_grams = np.ones(len(names), dtype=np.float32)
    for i, w in enumerate(names):
        g = trigrams(w)
        grams[i, : len(g)], n_grams[i] = g, len(g)
    valid = (np.arange(longest) < n_grams[:, None]).astype(np.float32)
    flat = np.array([uniq[w] for x in docs for w in x], dtype=np.int64)
    start, size, doc = window_index([len(x) for x in docs], width, hop)
    adam: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    steps = 0
    first = np.cumsum(np.append(np.float32(0), odds[ids[flat]].clip(0)))
    strength = first[start + size] - first[start]
    epochs = max(epochs, -(-least_steps * batch // max(1, 3 * len(docs))))
    for epoch in range(epochs):
        if epoch in (1, epochs // 2):
            strength = model.logits(model_table(model, names), flat, start, size)
        order = np.lexsort((rng.random(len(start)), -strength, doc))
        place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        top = order[place < windows_per_doc]
        top = top[(y[doc[top]] == 0) | (strength[top] >= 0.5 * np.maximum(strength[order[place == 0]], 1e-6)[np.searchsorted(doc[order[place == 0]], doc[top])]) | (np.isin(top, order[place == 0]))]
        calm = np.flatnonzero(y[doc] == 0)
        picked = np.unique(np.concatenate((top, rng.choice(calm, min(len(calm), int(len(top) * calm_share)), replace=False))))
        rng.shuffle(picked)
        for lo in range(0, len(picked), batch):
            w = picked[lo : lo + batch]
            idx = flat[start[w][None, :] + np.minimum(np.arange(width)[:, None], size[w] - 1)]
            mask = (np.arange(width)[:, None] < size[w]).astype(np.float32)
            own, back = np.unique(idx, return_inverse=True)
            chars = np.einsum("ugd,ug->ud", p["chars"][grams[own]], valid[own]) / n_grams[own][:, None]
            x = np.concatenate((p["words"][ids[own]], chars), axis=1)[back.reshape(idx.shape)]
            _, grad, dx = _step(model, x.astype(np.float32), mask, y[doc[w]])
            du = np.zeros((len(own), d), dtype=np.float32)
            np.add.at(du, back.ravel(), dx.reshape(-1, d))
            grad["words"] = np.zeros_like(p["words"])
            np.add.at(grad["words"], ids[own], du[:, :d_word])
            grad["words"][0] = 0
            grad["chars"] = np.zeros_like(p["chars"])
            np.add.at(grad["chars"], grams[own].ravel(), ((du[:, d_word:] / n_grams[own][:, None])[:, None, :] * valid[own][:, :, None]).reshape(-1, d_char))
            steps += 1
            rate = 0.01 if epoch < epochs - max(1, epochs // 4) else 0.003
            for k, g in grad.items():
                m, v = adam[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * np.square(g)
                p[k] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    model._table, model._memo, model._rows = None, {}, 0
    best = np.full(len(docs), -12.0)
    np.maximum.at(best, doc, model.logits(model_table(model, names), flat, start, size))
    model.a, model.b = _platt(np.clip(best, -12, 30), y)
    return model


def model_table(model: GruModel, names: list[str]) -> np.ndarray:
    x = model.inputs(names)
    return np.concatenate((x @ model.p["wf"] + model.p["bf"], x @ model.p["wb"] + model.p["bb"]), axis=1).astype(np.float32)


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (over 0) and offset of a logistic curve through the documents' highest logits."""
    a, b = 1.0, 0.0
    n_pos, n_neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    for _ in range(300):
        q = _sig(np.clip(a * x + b, -30, 30))
        w = q * (1 - q) + 1e-6
        g = np.array([((q - t) * x).sum() + 1e-3 * (a - 1), (q - t).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), g)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def choose_labels(labels: DataFrame, per_class: tuple[int, int], seed: int = 3) -> DataFrame:
    """Of distinct ids ``i`` with label ``y`` (0 or 1), for each label the ``per_class`` ids with the smallest seeded
    hash. Labels are counted first and twice the expected share of hashes passes, so that the task that ranks a label
    gets a few thousand ids from any number of partitions. Without rows the result is empty."""
    counts = {r["y"]: int(r["n"]) for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    span = 1 << 62
    h = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(span))
    near, wanted = F.lit(False), F.lit(0)
    for y, n in counts.items():
        near = near | ((F.col("y") == y) & (F.col("h") <= int(span * min(1.0, (2.0 * per_class[y] + 40) / n))))
        wanted = F.when(F.col("y") == y, F.lit(per_class[y])).otherwise(wanted)
    ranked = labels.withColumn("h", h).where(near).withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "i")))
    return ranked.where(F.col("r") <= wanted).select("i", "y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn_where, per_class: tuple[int, int] = (2500, 1500), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 3, **kw) -> GruModel:
    """Fit on at most ``per_class`` labelled documents (clean, toxic), those with the smallest seeded hash of the id.

    The documented bounds of the fit are this one and, in ``train``, ``windows_per_doc`` and ``calm_share``: texts are
    used whole, every word counts, and every document is scored. Null labels, ids and texts teach nothing. An id with
    both labels counts as toxic; rows repeated with id and text count once, and of an id with several texts the one
    with the smallest hash teaches. The labels are chosen first, so that only the chosen rows' texts are joined."""
    lab = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null").where(learn_where(F.col("i")))
    lab = materialize(lab.groupBy("i").agg(F.max((F.col("y") > 0).cast("int")).alias("y")), "toxicity-labels")
    chosen = choose_labels(lab, per_class, seed)
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    # At most sum(per_class) rows are broadcast.
    got = own.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).collect()
    got.sort(key=lambda r: str(r["i"]))
    return train([r["t"] for r in got], [int(r["y"]) for r in got], **kw)


def score_toxicity(docs: DataFrame, model: GruModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    Every window of every whole text is run through the network. Null, empty and word-less texts get the score of
    the lowest evidence. Very long texts are scored whole, in blocks of windows. Columns of those names are replaced;
    other columns and repeated rows stay. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model.bare())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value.bare()
        for s in batches:
            yield pd.Series(own.score([t if isinstance(t, str) else None for t in s]))

    out = docs.drop("score", "predicted").withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
