"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd inputs."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspark.llm import decontam, entries, html_extract, langid, license_scan, line_dedup, mixing, ngram_join, sharding, topk, toxicity
from eventspark.llm.common import table
from eventspark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score string, rank int, start int"
LONG = "lorem ipsum dolor " * 30_000


def docs_of(spark, texts, source="s"):
    """Documents with columns whose names clash with those that operators add."""
    rows = [(i, t, "en", source if not callable(source) else source(i), None, 9, "x", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "one two three"), (7, LONG), (8, "Ünï ßtraße 漢字 🎉 !!!")]


# -- sharding --------------------------------------------------------------------------------------------------


def test_differencing_balances_and_places_everything():
    rng = random.Random(1)
    sizes = [rng.randint(1, 5000) for _ in range(500)]
    place = sharding.difference([[s] for s in sizes], 8)
    sums = Counter()
    for s, p in zip(sizes, place, strict=True):
        sums[p[0]] += s
        assert sorted(p) == list(range(8))
    assert max(sums.values()) - min(sums.values()) <= 8
    assert sharding.difference([], 8) == []


@pytest.mark.parametrize("buckets, off", [({}, 1.001), ({"bucket_groups": 20, "fan_in": 3}, 1.15)])
def test_shards_by_bytes(spark, buckets, off):
    docs = table(spark, SF, "documents")
    got = sharding.shard_by_bytes(docs, 8, **buckets).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(text)
    by_shard, of_text = defaultdict(list), {}
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 1
        assert r["text_crc32"] == zlib.crc32(t.encode())
        assert of_text.setdefault(t, r["shard"]) == r["shard"]
        by_shard[r["shard"]].append(r)
    sums = [sum(r["size"] for r in v) for v in by_shard.values()]
    assert len(sums) == 8
    assert max(sums) <= sum(sums) / 8 * off
    for v in by_shard.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    odd = sharding.shard_by_bytes(docs_of(spark, ODD), 3).collect()
    assert len(odd) == len(ODD)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in odd if r["doc_id"] in (1, 2)} == {1: (1, None), 2: (1, 0)}
    assert sharding.shard_by_bytes(docs_of(spark, ODD).where("false")).collect() == []


def test_written_shards_of_odd_rows(spark, tmp_path):
    docs = docs_of(spark, [*ODD, (None, "other"), (1, "one id, two texts")])
    sharding.write_shards(sharding.shard_by_bytes(docs, 3), docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    key = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert key(back) == key(docs)


def test_written_shards_round_trip(spark, tmp_path):
    docs = table(spark, SF, "documents")
    placed = sharding.shard_by_bytes(docs, 4)
    sharding.write_shards(placed, docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())


# -- mixing ----------------------------------------------------------------------------------------------------


def test_water_filling():
    got = mixing.water_fill({"a": 10, "b": 100, None: 5, "c": 100})
    assert got["a"] == 20
    assert got[None] <= 10
    assert sum(got.values()) == Fraction(3, 2) * 215
    assert mixing.water_fill({}) == {}
    assert mixing.water_fill({"a": 0}) == {"a": 0}


def test_budget_fitting_reaches_every_reachable_budget():
    rng = random.Random(2)
    for _ in range(150):
        sizes = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(1, 4) for _ in sizes]
        reach = {sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*[range(c + 1) for c in counts])}
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts, strict=True)))
        take = mixing.fit_budget(sizes, counts, budget)
        got = sum(s * k for s, k in zip(sizes, take, strict=True))
        assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))
        assert got == max(x for x in reach if x <= budget)


def test_mix(spark):
    docs = table(spark, SF, "documents")
    a, b = (sorted(map(tuple, mixing.mix_sources(docs).drop("source").collect())) for _ in range(2))
    assert a == b
    info = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in docs.collect()}
    totals, taken, target = Counter(), Counter(), {}
    for s, n in info.values():
        totals[s] += n
    for doc, size, source_size, goal, took in a:
        s, n = info[doc]
        assert (size, source_size) == (n, totals[s])
        assert took in (0, n, 2 * n)
        taken[s] += took
        target[s] = goal
    assert target == {s: float(t) for s, t in mixing.water_fill(dict(totals)).items()}
    for s in totals:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 5
    odd = mixing.mix_sources(docs_of(spark, ODD, lambda i: None if i == 7 else "s")).collect()
    assert len(odd) == len(ODD)
    assert all(r["taken"] == 0 for r in odd if r["size"] == 0)
    assert mixing.mix_sources(docs_of(spark, ODD).where("false")).collect() == []


# -- decontamination -------------------------------------------------------------------------------------------


def brute_hits(docs, bench, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = defaultdict(set)
    for i, t in bench:
        w = words(t)
        if w and i is not None:
            for a in range(max(1, len(w) - n + 1)):
                grams[tuple(w[a : a + n])].add(str(i))
    lens, out = {len(g) for g in grams}, []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for m in lens:
            for a in range(len(w) - m + 1):
                if found := grams.get(tuple(w[a : a + m])):
                    items |= found
                    hit |= set(range(a, a + m))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [20_000, 3])
def test_decontamination(spark, rows):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    texts, items = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]
    plant = [(9001, "x " + items[0][1].upper() + " y"), (9002, "short item here"), (9003, "Short, item; É a b c d e f g"), *[x for x in ODD if x[0] != 5], (9004, items[1][1] + " " + items[2][1])]
    extra = [(900, "SHORT item"), (901, None), (902, "!!"), (None, items[3][1]), (903, "漢字 🎉")]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(plant, "doc_id long, text string")).withColumn("at", F.lit(1)).withColumn("len", F.lit(1))
    all_items = bench.select("item_id", "text").union(spark.createDataFrame(extra, "item_id long, text string"))
    got = decontam.decontaminate(all_docs, all_items, broadcast_rows=rows).drop("hit_at").collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(texts + plant, items + extra)
    assert sum(r["contaminated"] for r in got) >= 3


@pytest.mark.parametrize("n", [1, 2, 5])
def test_decontamination_by_short_windows(spark, n):
    got = decontam.decontaminate(docs_of(spark, [(1, "a b c d e f g h"), (2, "x a c e y"), (3, None)]), spark.createDataFrame([("i", "z b c d e f q")], "item_id string, text string"), n=n).collect()
    want = {1: {1: 5, 2: 5, 5: 5}[n], 2: {1: 2, 2: 0, 5: 0}[n], 3: 0}
    assert {r["doc_id"]: r["n_hit"] for r in got} == want


@pytest.mark.parametrize("rows", [20_000, 0])
def test_decontamination_of_capital_sigma(spark, rows):
    bench = spark.createDataFrame([(1, "ΟΔΟΣ ΑΒ"), (2, "Η ΟΔΟΣ ΤΩΝ ΘΕΩΝ ΚΑΙ ΛΟΓΟΣ ΑΒ")], "item_id int, text string")
    docs = docs_of(spark, [(1, "ΟΔΟΣ.ΑΒ"), (2, "ΟΔΟΣ ΑΒ"), (3, "Η ΟΔΟΣ.ΤΩΝ ΘΕΩΝ ΚΑΙ ΛΟΓΟΣ'ΑΒ"), (4, "οδος αβ")])
    got = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(docs, bench, n=13, broadcast_rows=rows).collect()}
    assert got == {1: 2, 2: 2, 3: 7, 4: 0}


def test_decontamination_without_benchmark(spark):
    docs = docs_of(spark, ODD)
    got = decontam.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(ODD)
    assert not any(r["contaminated"] or r["n_hit"] for r in got)


# -- n-gram join -----------------------------------------------------------------------------------------------


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed=3, groups=12):
    """Chains and stars of edited copies around the threshold, of 1 to 200 words, some sharing a common passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice((1, 3, 5, 7, 9, 12, 20, 40, 90, 200)))]
        if g % 2:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        last = base
        for k in range(8):
            own = list(last if k % 2 else base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own += [word()]
            last = own
            out.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in own))
    rng.shuffle(out)
    return [(1000 - i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_all_components(spark, seed):
    texts = near_copies(seed=seed) + [(1, None), (2, ""), (3, " \n\t "), (7, LONG), (8, LONG + " x")]
    tile_rows = 2 if seed == 1 else 20_000
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs_of(spark, texts).repartition(5), tile_rows=tile_rows).collect()}
    assert got == brute_components(texts)


def long_texts(seed=8):
    """Long texts with one passage in common, some of them similar pairs of sizes on both sides of a power of two."""
    rng = random.Random(seed)
    words = lambda n: [f"{rng.randrange(10**9):x}" for _ in range(n)]
    passage, out = words(900), []
    for i, n in enumerate((700, 1010, 1100, 2000, 2020, 2100, 4000, 4090, 5000)):
        own = words(n)
        edited = own[: int(n * 0.96)] + words(int(n * 0.05))
        out += [(3 * i + 1, " ".join(own + passage)), (3 * i + 2, " ".join(edited + passage)), (3 * i + 3, " ".join(words(n) + passage))]
    return out


def test_join_of_long_texts(spark):
    texts = long_texts()
    found = ngram_join.join_components(docs_of(spark, texts).repartition(5), tile_rows=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts)


def test_join_of_equal_ids_with_unequal_texts(spark):
    a, b = "one two three four five six seven", "ein zwei drei vier fuenf sechs sieben"
    texts = [(1, a), (1, b), (2, a), (3, b), (4, a + " and something else entirely besides it"), (4, b.upper()), (5, "so")]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.join_components(docs_of(spark, texts).repartition(4)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((1000, 1100), (2000, 2100), (5000, 9000)):
        a, b = (np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate((a[: n // 2], b[n // 2 :])))
        apart = len(np.setxor1d(a, b))
        x, y = ngram_join.sketch(a)[None, :].view(np.uint64), ngram_join.sketch(b)[None, :].view(np.uint64)
        assert apart * 0.2 < int(ngram_join._apart(x, y)[0, 0]) <= apart


def test_join_on_the_table_and_odd_rows(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    odd = ngram_join.join_components(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD)
    assert {r["doc_id"]: r["component_id"] for r in odd} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None, 7: 7, 8: 8}
    assert ngram_join.join_components(docs_of(spark, ODD).where("false")).collect() == []


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    scheme = ngram_join.PartEnum()
    for n in [*range(1, 60), 90, 150, 400, 1000]:
        for _ in range(20):
            u = np.unique(rng.integers(0, 2**63, 2 * n + 2).astype(np.uint64))
            rng.shuffle(u)
            apart = int(0.2 * n)  # of a union of n
            cut = rng.integers(0, apart + 1)
            a, b = np.sort(u[: n - cut]), np.sort(np.concatenate((u[: n - apart], u[n - cut : n])))
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if len(a) and len(b) and 5 * both >= 4 * either:
                assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size, (n, cut)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert got == {x: find(x) for x in root}


# -- line runs and licenses ------------------------------------------------------------------------------------


def brute_lines(docs, least=50):
    lines = {(i, t): [(k, x, len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in docs if t is not None}
    gone, first = defaultdict(set), {}
    for i in sorted(lines):
        own = lines[i]
        for p in range(len(own)):
            words = 0
            for e in range(p, len(own)):
                words += own[e][2]
                if words >= least:
                    key = tuple(x[1] for x in own[p : e + 1])
                    if first.setdefault(key, (i, p)) < (i, p):
                        gone[i].update(x[0] for x in own[p : e + 1])
    return gone


def test_line_runs(spark):
    rng = random.Random(6)
    pool = [" ".join(f"w{k}{j}" for j in range(rng.choice((1, 4, 9, 20, 30, 60)))) for k in range(14)]
    texts = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {i} {rng.random()}" for _ in range(rng.randint(1, 14)))) for i in range(40)]
    texts += [(101, texts[3][1]), (102, "\n\n" + pool[3] + "\n\n" + pool[4] + "\n"), (103, None), (104, ""), (105, "\n".join(["a"] * 200)), (None, texts[3][1])]
    got = line_dedup.dedup_lines(docs_of(spark, texts)).collect()
    want = brute_lines([(-(1 << 63) if i is None else i, t) for i, t in texts])
    assert len(got) == len(texts)
    for r in got:
        key = (-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["text"])
        assert r["gone"] == sorted(want.get(key, ())), r["doc_id"]
        if r["text"] is not None:
            parts = r["text"].split("\n")
            assert r["n_lines"] == len(parts)
            assert r["kept_text"] == "\n".join(x for k, x in enumerate(parts) if k not in want.get(key, ()))
    assert line_dedup.dedup_lines(docs_of(spark, texts).where("false")).collect() == []


def test_line_runs_of_repeated_rows(spark):
    passage = "\n".join(" ".join(f"p{n}w{j}" for j in range(n)) for n in (25, 3, 4, 19))
    texts = [(1, "one\n" + passage), (2, passage + "\ntwo"), (2, passage + "\ntwo"), (3, "a\nb\n" + passage)]
    for some in (texts, [*texts, texts[0], texts[1]]):
        want = brute_lines(some)
        got = line_dedup.dedup_lines(docs_of(spark, some)).collect()
        assert len(got) == len(some)
        assert {(r["doc_id"], tuple(r["gone"])) for r in got} == {(i, tuple(sorted(want[i, t]))) for i, t in some}
        assert want[texts[1]] == {0, 1, 2, 3}


def test_recall_of_changed_licenses(spark):
    """Templates with words replaced, of which 0.8 to all but one of the shingles are left, at any place of a text."""
    rng = random.Random(23)
    noise = lambda n: ["".join(rng.choice("xyzuvw") for _ in range(6)) for _ in range(n)]
    rows, want = [], []
    for name, text in sorted(license_scan.TEMPLATES.items()):
        words = re.findall(r"[a-z0-9]+", text.lower())
        shingles = lambda w: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        whole = shingles(words)
        for _ in range(400 if len(whole) >= 5 else 0):
            own = list(words)
            for i in rng.sample(range(len(own)), rng.randint(1, 1 + len(own) // 25)):
                own[i] = noise(1)[0]
            if 0.8 * len(whole) <= len(whole & shingles(own)) < len(whole) and sum(n == name for _, n in want) < 25:
                want.append((len(rows), name))
                rows.append((len(rows), " ".join(noise(rng.randint(0, 150)) + own + noise(rng.randint(0, 150)))))
    assert len(want) >= 100
    got = license_scan.licenses_of(docs_of(spark, rows), license_scan.default_templates(spark)).collect()
    found = {(r["doc_id"], n) for r in got for n in r["licenses"].split(",")}
    assert len(found & set(want)) >= 0.98 * len(want)


def test_licenses(spark):
    rng = random.Random(7)
    noise = lambda n: " ".join("".join(rng.choice("xyzuvw") for _ in range(5)) for _ in range(n))
    names = sorted(license_scan.TEMPLATES)
    texts, want = [], {}
    for i in range(60):
        chosen = rng.sample(names, rng.randint(0, 2))
        body = noise(rng.randint(0, 300))
        for c in chosen:
            body += " " + license_scan.TEMPLATES[c].upper() + " " + noise(rng.randint(0, 200))
        texts.append((i, body))
        want[i] = set(chosen) | ({"Apache-2.0"} if "Apache-2.0-header" in chosen else set())
    broken = license_scan.TEMPLATES["MIT-text"].split()
    broken[10] = broken[40] = "changed"
    texts += [(100, noise(50) + " " + " ".join(broken)), (101, None), (102, ""), (103, "licensed under the"), (104, " ".join(broken[:20]))]
    want |= {100: {"MIT-text"}, 101: set(), 102: set(), 103: set(), 104: set()}
    for rows in (20_000, 2):
        got = license_scan.licenses_of(docs_of(spark, texts), license_scan.default_templates(spark), anchor_rows=rows).collect()
        for r in got:
            found = set(filter(None, r["licenses"].split(",")))
            words = re.findall(r"[a-z0-9]+", (dict(texts)[r["doc_id"]] or "").lower())
            have = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
            held = {n for n, t in license_scan.TEMPLATES.items() if (s := {" ".join(x) for w in [re.findall(r"[a-z0-9]+", t.lower())] for x in zip(*[w[j:] for j in range(5)], strict=False)}) and len(s & have) >= 0.8 * len(s)}
            assert want[r["doc_id"]] <= found <= held, r["doc_id"]
    assert license_scan.licenses_of(docs_of(spark, texts).where("false"), license_scan.default_templates(spark)).collect() == []
    assert len(license_scan.licenses_of(docs_of(spark, texts), spark.createDataFrame([(None, "a b"), ("x", None)], "template string, text string")).collect()) == len(texts)


# -- top-k -----------------------------------------------------------------------------------------------------


def test_topk(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=12) * rng.choice((0.1, 1, 3))]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(30)]  # ties
    odd = [(401, None), (402, [1.0, None] + [0.0] * 10), (403, [float("nan")] * 12), (404, [float("inf")] * 12), (405, [1.0] * 3), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int, score int, floor int")
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=7, bucket_rows=16, query_rows=5).collect()
    v = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows}
    want = []
    for q in (i for i in v if i % 20 == 0):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:7]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []
    assert len(topk.search(df.where("vec_id < 3"), F.col("vec_id") == 0, k=20).collect()) == 2
    huge = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.search(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63) + 1)]


@pytest.mark.parametrize("spread", [True, False])
def test_topk_prunes(spread):
    """Both prunings exclude pairs and lose no result: by length where lengths differ, by coordinates where the floors
    are near the products of the lengths."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16)) * (rng.lognormal(0, 1.5, size=(400, 1)) if spread else 1)
    if not spread:
        v[:200] = v[0] + rng.normal(size=(200, 16)) * 0.05
    v = np.floor(64 * v).astype(np.int64)
    ids = np.arange(400)
    own = ids[::10]
    product = v[own] @ v.T
    product[np.arange(len(own)), own] = np.iinfo(np.int64).min
    floor = np.sort(product, axis=1)[:, -5].astype(float)
    bucket = topk.Bucket(ids, v)
    got = {int(own[i]): sorted(zip((-s).tolist(), c.tolist())) for i, c, s in bucket.search(v[own], own, floor, 5)}
    want = {int(q): sorted((-int(p), int(c)) for c, p in enumerate(row) if c != q)[:5] for q, row in zip(own, product)}
    assert got == want
    assert (bucket.cut_by_length if spread else bucket.cut_by_coordinate) > 0


def test_topk_sends_vectors_where_they_can_count(spark, monkeypatch):
    """Short vectors reach no block of queries whose floors are out of their reach."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    x *= np.where(np.arange(600) % 3 == 0, 20.0, 0.01)[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    sent, cells = [], topk._cells

    def spy(cand, asks, n_buckets, k):
        sent.append((cand.where("last < 0").count(), cand.count(), asks.where("first > 0").count()))
        return cells(cand, asks, n_buckets, k)

    monkeypatch.setattr(topk, "_cells", spy)
    got = topk.search(df, F.col("vec_id") % 30 == 0, k=2, bucket_rows=32, query_rows=4).collect()
    v = np.floor(64 * x).astype(np.int64)
    want = [(q, n + 1, c, -s) for q in range(0, 600, 30) for n, (s, c) in enumerate(sorted((-int(v[q] @ v[c]), c) for c in range(600) if c != q)[:2])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sent[-1][0] > 300 and sent[-1][1] == 600 and sent[-1][2] == 20


# -- html ------------------------------------------------------------------------------------------------------


PAGES = {
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p><b>One  two.<br><p>Three,\n four.</article><footer>Foot</footer>": "Head & more\n\nOne two.\n\nThree, four.",
    '<body><div class="ad">Buy this now, please.</div><main><p>Text one.</p><aside>Side.</aside><ul><li>A b</li><li>C d</ul><form><p>Your name</p></form><script>var t="</p>";</script></main>': "Text one.\n\nA b\n\nC d",
    '<body><div id="content"><h2>Title</h2><p>A first paragraph, of some length.</p></div><div id="comments"><p>A reader says, rather loudly, that it is so.</p></div></body>': "Title\n\nA first paragraph, of some length.",
    "<p>&lt;b&gt; &eacute;&#x41;&nbsp;z</p>": "<b> éA z",
    "": "",
    "plain text only": "plain text only",
    "<article></article>": "",
    "<article><p>Left <a href=y>linked</a> right.</p><div class='cookie-notice'>We use cookies.</div><div class=comments><p>no</p></div></article>": "Left linked right.",
}


def test_html(spark):
    for page, text in PAGES.items():
        assert html_extract.main_text(page) == text
    df = spark.createDataFrame([(i, h, "old") for i, h in enumerate([*PAGES, None, "<div>" * 3000 + "deep"])], "page_id long, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert [got[i]["text"] for i in range(len(PAGES))] == list(PAGES.values())
    assert got[len(PAGES)]["text"] == "" and got[len(PAGES)]["n_chars"] == 0
    assert got[3]["n_chars"] == len(got[3]["text"])


def test_html_of_any_markup():
    assert html_extract.main_text("<p>a, b.</p><![foo[bar]]><p>c, d.</p><![CDATA[x]]><![if IE]>e") == "a, b.\n\nc, d.\n\ne"
    rng = random.Random(2)
    bits = ["<![", "]]>", "<!", "<?x", "<!--", "-->", "&#x0;", "&#99999999;", "&amp", "<a href='", '"', "\x00", "<div", "</", ">", "<p>", "</p>", "<li>", "text, ", "<script>", "<table><td>"]
    for _ in range(500):
        assert isinstance(html_extract.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))), str)


def test_html_of_long_and_deep_pages():
    began = time.perf_counter()
    text = html_extract.main_text("<div>a, b. " * 3000)
    assert text.count("a, b.") == 3000
    assert html_extract.main_text("<div><p>a, b.</p></div>" * 20_000).count("a, b.") == 20_000
    assert time.perf_counter() - began < 30  # cubic work in the depth took minutes


def test_smoothing_over_sorted_paths():
    rng = np.random.default_rng(3)
    names = list({tuple(rng.choice(list("abc"), rng.integers(0, 6))) for _ in range(60)})
    sums = rng.random((len(names), 3))
    like = lambda p, q: 1.0 if p == q else next((i for i, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q))) / max(len(p), len(q), 1)
    want = np.exp(-8 * (1 - np.array([[like(p, q) for q in names] for p in names]))) @ sums
    assert np.allclose(html_extract._smoothed(names, sums, 8.0), want)


@pytest.mark.parametrize("box", ["<div class='box'><div class='text'>Weather 12</div></div>", "<article class='card'><p>Teaser one</p></article><article class='card'><p>Teaser two</p></article>"])
def test_html_story_beside_marked_boxes(box):
    story = [f"Paragraph {i} of the story, " + "told at some length, " * 15 + "ends." for i in range(8)]
    page = f"<body><div class='lead-col'>{''.join(f'<p>{x}</p>' for x in story)}</div>{box}</body>"
    assert html_extract.main_text(page) == "\n\n".join(story)


@pytest.mark.parametrize("tag", ["div class='lead-col'", "td"])
def test_html_keeps_lists_and_tables_of_the_story(tag):
    story = [f"Paragraph {i} of the story, " + "told at some length, " * 18 + "ends." for i in range(20)]
    rest = ["First of the list", "Second of the list", "Cell 1", "Cell 2", "Term", "What it means", "Seen from above"]
    more = "<ul><li>{}</li><li>{}</li></ul><table><tr><td>{}</td><td>{}</td></tr></table><dl><dt>{}<dd>{}</dl><figure><figcaption>{}</figcaption></figure>".format(*rest)
    page = f"<{tag}><p>{'</p><p>'.join(story)}</p>{more}</{tag.split()[0]}>"
    if tag == "td":
        page = f"<table><tr>{page}</tr></table>"
    page = f"<body><div class='box'>Weather 12</div>{page}<div class='box'>About us</div></body>"
    assert html_extract.main_text(page) == "\n\n".join(story + rest)


def test_html_on_the_table(spark):
    import html as h

    for r in html_extract.extract(table(spark, SF, "pages")).collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(x for x in blocks if x)


# -- language ID and toxicity ----------------------------------------------------------------------------------


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_language_fit_holds_no_dense_matrix():
    """3,000 texts by 8,192 columns are 98 MB as floats; the fit is that of all rows at once."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh" if i % 2 else "fghijklm", k=5)) for _ in range(8)) for i in range(3000)]
    langid.letters("a")
    tracemalloc.start()
    model = langid.train(texts, ["en" if i % 2 else "fr" for i in range(3000)], steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert [model.predict(t)[0] for t in texts[:200]] == ["fr", "en"] * 100
    # The same descent with one matrix.
    x = np.stack([langid.features(langid.letters(t), 256) for t in texts[:300]])
    kept = [langid.sparse(langid.letters(t), 256) for t in texts[:300]]
    at, value = (np.concatenate([k[i] for k in kept]) for i in range(2))
    rows = langid.SparseRows(at, value, np.cumsum([len(k[0]) for k in kept]), 256)
    assert all(np.array_equal(block, x[lo:hi]) for lo, hi, block in rows.blocks())
    y = np.where(np.arange(300) % 2, 1.0, -1.0).astype(np.float32)
    w, v = np.zeros(257), np.zeros(257)
    for t in range(20):
        pull = y / 300 * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        new = v - (1e-3 * np.append(v[:-1], 0) - 2 * np.append(x.T @ pull, pull.sum())) / 4.001
        v, w = new + t / (t + 3) * (new - w), new
    assert np.allclose(langid.fit_svms(rows, y[:, None], steps=20)[0], w, atol=1e-5)


def test_language_id(spark):
    from eventspark.llm.common import held_out

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit_languages(docs, ~held_out("doc_id"))
    assert set(model.members) == {"germanic", "romance"}
    got = [r for r in langid.identify(docs, model).collect() if not fold(r["doc_id"])]
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs_of(spark, [*ODD, (9, "123 !!"), (10, "𝒜𝒷")]), model).collect()}
    assert [odd[i][0] for i in (1, 2, 3, 9)] == ["und"] * 4
    assert odd[10][0] != "und"
    none = langid.fit_languages(docs_of(spark, [(1, None)]).withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs_of(spark, ODD), none).collect()} == {"und"}
    assert langid.train(["abc", "xyz"], ["en", "en"]).predict("abc")[0] == "en"


def test_network_gradients():
    rng = np.random.default_rng(9)
    m = toxicity.train(["good fine nice"] * 4 + ["bad awful vile"] * 4, [0] * 4 + [1] * 4, hidden=3, d_word=2, d_char=2, epochs=1, least_steps=1)
    m.p = {k: np.asarray(v, dtype=np.float64) for k, v in m.p.items()}
    x = rng.normal(size=(4, 3, 4))
    mask, y = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], dtype=float), np.array([1.0, 0.0, 1.0])
    _, grad, dx = toxicity._step(m, x, mask, y)
    for name in ("wf", "uf", "bf", "ub", "wa", "va", "wo"):
        at = np.unravel_index(1, m.p[name].shape)
        keep = m.p[name][at]
        m.p[name][at] = keep + 1e-5
        hi = toxicity._step(m, x, mask, y)[0]
        m.p[name][at] = keep - 1e-5
        lo = toxicity._step(m, x, mask, y)[0]
        m.p[name][at] = keep
        assert grad[name][at] == pytest.approx((hi - lo) / 2e-5, abs=2e-5), name
    x[2, 1, 1] += 1e-5
    hi = toxicity._step(m, x, mask, y)[0]
    x[2, 1, 1] -= 2e-5
    assert dx[2, 1, 1] == pytest.approx((hi - toxicity._step(m, x, mask, y)[0]) / 2e-5, abs=2e-5)


def test_windows_cover_every_token():
    start, size, doc = toxicity.window_index([0, 1, 32, 33, 100], 32, 16)
    assert set(doc) == {1, 2, 3, 4}
    covered = {i for s, n in zip(start, size, strict=True) for i in range(s, s + n)}
    assert covered == set(range(166))
    assert size.max() == 32


def test_toxicity_sees_the_middle_of_long_words():
    for n in (31, 32, 33, 48, 49, 64, 65, 300):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        got = toxicity.tokens(f"a {word} b")
        assert max(map(len, got)) <= 32
        assert {word[i : i + 3] for i in range(n - 2)} <= {t[i : i + 3] for t in got for i in range(len(t) - 2)}
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(600):
        own = [rng.choice("abcdefgh") for _ in range(rng.randint(80, 200))]
        at = rng.randint(30, len(own) - 30)
        own[at:at] = "xyxzxyyz" * (i % 2)
        texts.append("".join(own))
        labels.append(i % 2)
    model = toxicity.train(texts[:450], labels[:450])
    assert np.mean((model.score(texts[450:]) >= 0.5) == labels[450:]) >= 0.75


def test_toxicity(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(600):
        own = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice(("slurone", "slurtwo"))
        rows.append((i, " ".join(own), int(bad)))
    docs = docs_of(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    from eventspark.llm.common import held_out

    model = toxicity.fit_toxicity(docs, labels, lambda i: ~held_out(i))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(y, got[i]["predicted"], got[i]["score"]) for i, _, y in rows if not fold(i)]
    assert np.mean([y == p for y, p, _ in held]) >= 0.95
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, p, s in held)
    odd = toxicity.score_toxicity(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD)
    assert all(r["predicted"] == 0 for r in odd if r["doc_id"] in (1, 2, 3))
    assert toxicity.train([], []).score(["a", None]).shape == (2,)


def test_labels_chosen_by_hash(spark):
    ids = spark.range(20_000).selectExpr("id AS i", "int(id % 50 = 0) AS y").repartition(7)
    chosen = [(r["i"], r["y"]) for r in toxicity.choose_labels(ids, (300, 150)).collect()]
    hashed = [(r["h"], r["i"], r["y"]) for r in ids.selectExpr("i", "y", f"pmod(xxhash64(3, i), {1 << 62}L) AS h").collect()]
    for y, most in ((0, 300), (1, 150)):
        assert sorted(i for i, own in chosen if own == y) == sorted(i for _, i, _ in sorted(h for h in hashed if h[2] == y)[:most])
    assert toxicity.choose_labels(ids.where("y = 1").limit(5), (300, 150)).count() == 5
    assert toxicity.choose_labels(ids.where("i < 0"), (300, 150)).count() == 0


# -- queries ---------------------------------------------------------------------------------------------------

#: The columns of each query's contract, and of the queries without one.
CONTRACT = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_shard_balance": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_extract_html": "page_id url text n_chars",
    "op4_line_dedup": "doc_id n_lines n_gone gone_lines kept_chars kept_md5",
    "op5_ngram_join": "doc_id n_shingles component_id",
    "op6_license_scan": "doc_id n_licenses licenses",
    "op7_exact_topk": "query_id rank vec_id score",
    "op8_mix_weights": "doc_id size source_size target taken",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_queries_keep_their_contract(spark, name):
    out = entries.queries()[name](spark, SF)
    assert out.columns == CONTRACT[name].split()
    rows = out.collect()
    table_name, key = {"op3_extract_html": ("pages", "page_id"), "op7_exact_topk": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    source = table(spark, SF, table_name)
    if name == "op7_exact_topk":
        queries = source.where("vec_id % 20 = 0").count()
        assert len(rows) == 20 * queries
    else:
        assert Counter(r[key] for r in rows) == Counter(r[0] for r in source.select(key).collect())
    for r in rows:
        if "held_out" in out.columns:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert 0 <= r["score"] <= 1
        if name == "op1_toxicity":
            assert r["predicted"] == int(r["score"] >= 0.5)
        if name == "op2_shard_balance":
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        if name == "op3_extract_html":
            assert r["n_chars"] == len(r["text"])
        if name == "op8_mix_weights":
            assert r["taken"] <= 2 * r["size"]


def test_line_dedup_agrees_with_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(entries.oracle_sql()["op4_line_dedup"])
    names = [c[0] for c in want.description]
    out = entries.op4_line_dedup(spark, SF)
    assert sorted(names) == sorted(out.columns)
    assert Counter(map(tuple, out.select(*names).collect())) == Counter(want.fetchall())
