"""Merkle manifests, vector codes and SimHash groups against brute force, and on odd inputs."""

import hashlib
import random
import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventspark.llm import decontam, entries, html_extract, langid, merkle, simhash, topk, toxicity, vector_codes

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree long, idx long, bucket long, id string, fp string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y", "z") for r in rows], DOC)


# -- Merkle manifest -------------------------------------------------------------------------------------------


def tree_of(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        start = i // fanout * fanout
        run = nodes[start : start + fanout]
        out.append(("".join(run[: i - start]), "".join(run[i - start + 1 :])))
        i //= fanout
    return out


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest_by_hand(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r[0]))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    members = {k: sorted(v, key=lambda x: x[:3]) for k, v in groups.items()}
    trees = {k: tree_of([x[2] for x in members[k]], fanout) for k in order}
    top = tree_of([trees[k][-1][0] for k in order], fanout)
    out = []
    for j, k in enumerate(order):
        for i, x in enumerate(members[k]):
            path = siblings(trees[k], i, fanout) + siblings(top, j, fanout)
            out.append((str(x[3]), x[2], trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in path))))
    return sorted(out)


@pytest.mark.parametrize("fanout, levels", [(16, 1), (4, 2), (16, 3)])
def test_manifest(spark, fanout, levels):
    """Sources of one row, of just a run, of one more, of several levels; a null id and source, repeated rows, nulls, odd
    and very long texts."""
    rng = random.Random(fanout)
    rows = [(rng.randint(0, 10**12), source, rng.choice(["en", None]), rng.choice([None, 7]), rng.choice(["", "Abc", "ü漢", None])) for source, n in ((None, 5), ("a", 1), ("b", 16), ("ü", 17), ("z", 300), ("", 256), ("d", 257)) for _ in range(n)]
    rows += [(None, "a", "x", 1, "q"), (2**60 + 1, "a", "x", 1, "lorem ipsum " * 50_000), rows[0], rows[0]]
    made = merkle.build(docs_of(spark, rows), COLUMNS, "source", "doc_id", shape=merkle.Shape(fanout, levels))
    got = made.audit().collect()
    assert sorted((str(r["id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == manifest_by_hand(rows, fanout)
    assert all(r["verified"] and r["folded_root"] == made.root() for r in got)
    proofs = made.proofs().collect()
    assert len(proofs) == len(rows)
    assert all(merkle.fold(r["leaf"], r["lefts"], r["rights"]) == made.root() for r in proofs)


def test_manifest_tells_changed_rows(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(40)]
    changed = F.when(F.col("doc_id") == 7, F.lit("text 7")).otherwise(F.col("text"))
    made = merkle.build(docs_of(spark, rows), COLUMNS, "source", "doc_id", merkle.leaf([F.col(c) for c in COLUMNS[:-1]] + [changed]))
    assert [r["id"] for r in made.audit().collect() if not r["verified"]] == [7]
    same = merkle.build(docs_of(spark, rows[::-1]), COLUMNS, "source", "doc_id")
    other = merkle.build(docs_of(spark, [*rows[:-1], (39, "s", "en", 39, "text 39")]), COLUMNS, "source", "doc_id")
    assert made.root() == same.root() != other.root()


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.build(docs_of(spark, [(1, None, None, None, None)]), COLUMNS, "source", "doc_id")
    (r,) = one.audit().collect()
    assert (r["leaf"], r["root"], r["proof_sha256"], r["verified"]) == (sha("1:1----"), sha("1:1----"), sha(""), True)
    none = merkle.build(docs_of(spark, []), COLUMNS, "source", "doc_id")
    assert none.root() is None
    assert none.audit().collect() == none.proofs().collect() == []


# -- vector codes ----------------------------------------------------------------------------------------------


def codes_by_hand(rows, parts, codes, rounds, scale):
    """rows: (id, vector, label), kept ones of one dimension."""
    ints = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows]
    dim = len(ints[0][1])
    edges = [dim * p // parts for p in range(parts + 1)]
    cut = [[v[a:b] for a, b in zip(edges, edges[1:])] for _, v, _ in ints]
    seeds = sorted(range(len(ints)), key=lambda k: (ints[k][0] is None, ints[k][0], ints[k][1]))[:codes]
    books = [[cut[k][p] for k in seeds] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = defaultdict(list)
            for c in cut:
                of[nearest(p, c[p])[1]].append(c[p])
            new.append([[sum(x) // len(x) for x in zip(*of[j])] if of[j] else e for j, e in enumerate(books[p])])
        books = new
    out = []
    for (i, _, lab), c in zip(ints, cut):
        found = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return out, sha(text)


VEC = "vec_id long, embedding array<float>, label int, code string, error long, id int, v int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VEC)


@pytest.mark.parametrize("parts, codes, dim", [(4, 8, 8), (16, 64, 32), (3, 5, 8)])
def test_vector_codes(spark, parts, codes, dim):
    rng = np.random.default_rng(dim)
    good = [(int(i), [float(np.float32(x)) for x in rng.normal(size=dim)], int(i) % 3 or None) for i in rng.permutation(150)]
    good += [good[0], good[0], (7, good[1][1], 1), (None, good[2][1], 2), (500, [1000.0, -1000.0] * (dim // 2), 1), (501, [0.0] * dim, None)]
    bad = [(1, None, 1), (2, [float("nan")] + [0.0] * (dim - 1), 1), (3, [float("inf")] * dim, 1), (4, [None] * dim, 1), (5, [1.0], 1), (6, [], 1)]
    df = vectors_of(spark, [*good, *bad]).repartition(5)
    books = vector_codes.fit_codebooks(df, parts, codes, rounds=2, scale=256)
    want, digest = codes_by_hand(good, parts, codes, 2, 256)
    assert books.sha256() == digest
    got = vector_codes.label_errors(vector_codes.encode(df, books, label_col="label")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["id"], r["code"], r["error"], r["label"]) for r in got), key=key) == sorted(want, key=key)
    by = defaultdict(int)
    for _, _, e, lab in want:
        by[lab] += e
    assert all(r["label_error"] == by[r["label"]] for r in got)


def test_vector_codes_decode(spark):
    """As many codes as vectors: each is decoded to itself, up to the width of an integer."""
    rows = [(i, [float(i), -float(i) / 2, 0.25, 3.0], i) for i in range(20)]
    df = vectors_of(spark, rows)
    books = vector_codes.fit_codebooks(df, parts=2, codes=20, scale=256)
    for r in vector_codes.decode(vector_codes.encode(df, books), books).collect():
        assert r["error"] == 0
        assert np.allclose(r["decoded"], rows[r["id"]][1], atol=1 / 256)


def test_vector_codes_of_few_and_no_vectors(spark):
    few = vectors_of(spark, [(1, [1.0, 2.0], None)])
    books = vector_codes.fit_codebooks(few, parts=2, codes=64)
    assert [r["code"] for r in vector_codes.encode(few, books).collect()] == ["0000"]
    for df in (vectors_of(spark, []), vectors_of(spark, [(1, None, 1)])):
        books = vector_codes.fit_codebooks(df)
        assert vector_codes.label_errors(vector_codes.encode(df, books, label_col="label")).collect() == []
    empty = vectors_of(spark, [(2, [], 1), (1, [], 1)])
    assert [r["error"] for r in vector_codes.encode(empty, vector_codes.fit_codebooks(empty)).collect()] == [0, 0]
    with pytest.raises(ValueError, match="codes"):
        vector_codes.fit_codebooks(few, codes=257)


# -- SimHash ---------------------------------------------------------------------------------------------------


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(fps, most):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_numbers(rng, n, most):
    base = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    return sorted({reduce(lambda x, _: x ^ 1 << rng.randrange(64), range(rng.randint(0, 2 * most + 1)), rng.choice(base)) for _ in range(n)})


def rank(x):
    for by in (1, 2, 4, 8, 16, 32):
        x ^= x >> by
    return x


@pytest.mark.parametrize("n, most", [(2, 2), (9, 0), (700, 2), (700, 3)])
def test_gray_index_finds_all_pairs(n, most):
    fps = sorted(near_numbers(random.Random(n), n, most), key=rank)
    index = simhash.GrayIndex(np.array(fps, dtype=np.uint64))
    got = sorted((int(i), int(j)) for p in index.pairs(most, chunk=64) for i, j in zip(*p))
    assert got == [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= most]


def test_gray_index_prunes():
    rng = random.Random(1)
    fps = sorted({rng.getrandbits(64) for _ in range(3000)}, key=rank)
    index = simhash.GrayIndex(np.array(fps, dtype=np.uint64))
    list(index.pairs(2))
    assert index.compared < 3000 * 2999 / 2 / 2


@pytest.mark.parametrize("most", [1, 2, 3])
def test_masks_bring_near_numbers_together(most):
    rng, masks = random.Random(most), simhash.sharing_masks((1 << 64) - 1, most)
    for _ in range(500):
        flips = reduce(lambda x, b: x ^ 1 << b, rng.sample(range(64), most), 0)
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("most, capacity", [(2, 1 << 16), (2, 3), (1, 5)])
def test_links_connect_all_near_numbers(spark, most, capacity):
    """Also when nodes are split over and over; ranks in Spark are those of the Gray code."""
    fps = near_numbers(random.Random(most + capacity), 400, most)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    assert [r["fp"] for r in df.orderBy(simhash.gray_rank(F.col("fp"))).collect()] == [x - (1 << 64) if x >> 63 else x for x in sorted(fps, key=rank)]
    at = {x: i for i, x in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash.near_links(df, most, capacity).collect():
        a, b = find(at[r["u"]]), find(at[r["v"]])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == groups_by_hand(fps, most)


def test_simhash_groups(spark):
    """Nulls, texts without words and short ones, repeated rows, an id with two texts, rows without an id, long texts."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(6)]
    texts = [b for b in base for _ in range(3)] + [b + " one more word" for b in base] + [None, "", " \n", "A b", "a  B", "one", "Ünï ßtraße 漢字", "lorem ipsum dolor " * 30_000, "Lorem ipsum dolor " * 30_001]
    rows = [(i if i != 5 else None, "s", "en", None, t) for i, t in enumerate(texts)] + [(3, "s", "en", None, texts[3]), (4, "s", "en", None, "another text of id four")]
    got = simhash.near_groups(docs_of(spark, rows)).collect()
    fps = [fingerprint_by_hand(r[4]) for r in rows]
    lows = defaultdict(list)
    for r, c in zip(rows, groups_by_hand(fps, 2)):
        lows[c].append(r[0])
    want = [(r[0], x, min((i for i in lows[c] if i is not None), default=None)) for r, x, c in zip(rows, fps, groups_by_hand(fps, 2))]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert simhash.near_groups(docs_of(spark, [])).collect() == []
    alone = simhash.near_groups(docs_of(spark, [(None, "s", "en", None, "a b c")])).collect()
    assert [(r["id"], r["component_id"]) for r in alone] == [(None, None)]


def test_simhash_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [fingerprint_by_hand(r["text"]) for r in docs]
    want = {r["doc_id"]: (f"{x:016x}", docs[c]["doc_id"]) for r, x, c in zip(docs, fps, groups_by_hand(fps, 2))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entries.op13_simhash_groups(spark, SF).collect()} == want


# -- earlier operators: layouts, many languages, ids with two vectors, empty tables ------------------------------

STORY = [f"Sentence {i} of the story, which goes on for a while and ends with a stop." for i in range(8)]
BODY = "".join(f"<p>{s}</p>" for s in STORY)
OTHERS = "<p>I do not agree, sir.</p>", "<p>Buy this now, at once.</p>", "<li><a href=x>Home</a></li><li><a href=y>News</a></li>"


@pytest.mark.parametrize("tag", ["article", "div", "section"])
@pytest.mark.parametrize("name", ["post hentry category-search", "post hentry tag-cookie", "hentry category-newsletter", "story comments-open", "post ad-free", "post type-post hentry format-standard", "entry status-publish comments-closed", "tag-sponsored cat-menu post", "h-entry topic-login", "single term-popup content"])
def test_html_story_named_by_blog_software(tag, name):
    comments, advert, menu = OTHERS
    page = f"<html><body><ul class='nav-menu'>{menu}</ul><{tag} class='{name}'>{BODY}</{tag}><div class='comments-area'>{comments * 30}</div><div class='ad-slot'>{advert}</div></body></html>"
    assert html_extract.main_text(page) == "\n\n".join(STORY)


@pytest.mark.parametrize("page", [
    "<div id=top><div id=x1><ul>{menu}</ul></div><div id=x2>{body}</div><div id=x3><ul>{menu}{menu}</ul></div></div>",
    "<table><tr><td><ul>{menu}</ul></td><td>{body}</td></tr></table>",
    "<div class=c1>{body}</div><div class=c2><ul>{menu}</ul></div>",
    "<ul class=a>{menu}</ul><div class=b><div class=c>{body}</div></div>",
    "<section class=left><ol>{menu}{menu}</ol></section><section class=right>{body}</section>",
    "<center>{body}</center><div><ul>{menu}</ul></div>",
])
def test_html_of_neutral_names_is_left_to_the_ratios(page):
    """No article element and no telling name: the paths of links alone go by their ratios."""
    assert html_extract.main_text(f"<html><body>{page.format(body=BODY, menu=OTHERS[2] * 3)}</body></html>") == "\n\n".join(STORY)


def test_html_keeps_link_lists_of_the_story():
    page = f"<body><nav>{OTHERS[2]}</nav><article>{BODY}<h2>Sources</h2><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul></article><ul class='related-links'>{OTHERS[2]}</ul></body>"
    assert html_extract.main_text(page).endswith("Sources\n\nFirst source\n\nSecond source")
    assert "Home" not in html_extract.main_text(page)


def test_many_languages_are_told_apart(spark):
    """More labels than an expression could hold; each of an own family, and some of one family beside them."""
    n = 1500
    rows = [(i, f"{chr(0x4E00 + i % n) * 3} word", f"x{i % n}") for i in range(2 * n)] + [(9000 + i, t, lang) for i in range(4) for t, lang in (("der hund und die katze", "de"), ("the dog and the cat", "en"), ("hunden och katten", "sv"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(df, F.lit(True), per_lang=2, dim=256)
    assert len(model.members) == n + 1
    assert len(model.pairs) == 3
    got = langid.identify(df.where("doc_id >= 9000"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 10


def test_language_fit_apart_is_the_fit_in_one_place(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices(letters, k=5)) for _ in range(9)), lang) for i in range(240) for letters, lang in (("abcdef", "de"), ("cdefgh", "en"), ("ghijkl", "fr"), ("mnopqr", "es"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    apart, one = langid.fit_languages(df, F.lit(True), dim=512), langid.train([r[1] for r in rows], [r[2] for r in rows], dim=512)
    for r in rows[::7]:
        assert apart.predict(r[1])[0] == one.predict(r[1])[0]
    assert all(np.allclose(apart.pairs[k], one.pairs[k], atol=1e-3) for k in one.pairs)
    assert all(np.allclose(apart.fam[k], one.fam[k], atol=1e-3) for k in one.fam)


def test_sparse_rows_multiply_alike_for_few_and_many_columns():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 64)) * (rng.random((300, 64)) < 0.1)).astype(np.float32)
    x[:, 0] = 1
    at, ends = np.nonzero(x)[1].astype(np.uint16), np.cumsum((x != 0).sum(axis=1))
    rows, v = langid.SparseRows(at, x[x != 0], ends, 64, most=128), rng.normal(size=(64, 9)).astype(np.float32)
    for k in (1, 9):
        slope, total = rows.products(v[:, :k], lambda lo, hi, p: p * 2)
        assert np.allclose(slope, 2 * x.T @ (x @ v[:, :k]), rtol=1e-4, atol=1e-3)
        assert np.allclose(total, 2 * (x @ v[:, :k]).sum(axis=0), rtol=1e-4, atol=1e-3)


def test_one_vector_asks_for_an_id_that_has_several(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    for order in (rows, rows[::-1]):
        got = topk.search(spark.createDataFrame(order, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") == 0).collect()
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 4096), (1, 0)]


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = langid.fit_languages(docs, F.lit(True))
    assert langid.identify(docs, model).collect() == []
    assert decontam.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"), n=13).collect() == []
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    network = toxicity.fit_toxicity(docs, labels, lambda i: F.lit(True))
    assert toxicity.score_toxicity(docs.select("doc_id", "text"), network).collect() == []


# -- the queries -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_vector_codes"])
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entries.queries()[name](spark, SF).toPandas()
    want = con.execute(entries.oracle_sql()[name]).df()[list(got.columns)]
    by = got.columns[0]
    assert got.sort_values(by).reset_index(drop=True).equals(want.sort_values(by).reset_index(drop=True))


def test_lines_of_long_documents_are_kept_in_linear_time(spark):
    import time

    from eventspark.llm import line_dedup

    def took(n):
        text = "\n".join(f"line number {i} of many" for i in range(n))
        began = time.perf_counter()
        got = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).select("doc_id", F.size("gone").alias("gone"), "kept_text").collect()
        assert [(r["gone"], r["kept_text"] == text) for r in sorted(got)] == [(0, True), (n, False)]
        return time.perf_counter() - began

    took(100)
    short = took(5_000)
    assert took(40_000) < 4 * short + 10
