"""Queries ``opN_<name>`` over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import decontam, html_extract, langid, license_scan, line_dedup, merkle, mixing, ngram_join, sharding, simhash, topk, toxicity, vector_codes
from eventspark.llm.common import held_out, materialize, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=8)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    gone = F.size("gone").cast("long")
    return out.select("doc_id", "n_lines", gone.alias("n_gone"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("gone_lines"), F.length("kept_text").cast("long").alias("kept_chars"), F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.licenses_of(docs, license_scan.default_templates(spark)).select("doc_id", "n_licenses", "licenses")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), k=5, num=4, den=5)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs, ~held_out("doc_id"))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13).drop("hit_at")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents`` by source, each row checked against its proof; of a fifth, capital letters are changed
    before the check. See ``merkle.build`` for nulls, ties and empty tables."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    text = F.when(held_out("doc_id"), F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    manifest = merkle.build(docs, columns, "source", "doc_id", merkle.leaf([F.col(c) for c in columns[:-1]] + [text]))
    return manifest.audit().select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all ``embeddings``; see ``vector_codes.fit_codebooks`` for nulls, ties and odd dimensions."""
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit_codebooks(vectors, parts=16, codes=64, rounds=2, scale=256)
    out = materialize(vector_codes.encode(vectors, books, label_col="label"), "codes-rows")
    out = vector_codes.label_errors(out)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near duplicates of all ``documents``; see ``simhash.near_groups`` for nulls, ties and empty tables."""
    out = simhash.near_groups(table(spark, sf_dir, "documents"), most=2, k=3, seed=42)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_shard_balance": op2_shard_balance,
        "op3_extract_html": op3_extract_html,
        "op4_line_dedup": op4_line_dedup,
        "op6_license_scan": op6_license_scan,
        "op5_ngram_join": op5_ngram_join,
        "op7_exact_topk": op7_exact_topk,
        "op8_mix_weights": op8_mix_weights,
        "op9_language_id": op9_language_id,
        "op10_decontaminate": op10_decontaminate,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_vector_codes": op12_vector_codes,
        "op13_simhash_groups": op13_simhash_groups,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Runs of lines with 50 words or more that start, and that end, at each line; of equal runs the first one stays.
OP4_SQL = """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
a AS (SELECT DISTINCT doc_id, text, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM d),
w AS (SELECT *, len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM a),
p AS (SELECT *, row_number() OVER k AS pos, sum(words) OVER k AS till, sum(words) OVER k - words AS since FROM w WHERE words > 0 WINDOW k AS (PARTITION BY doc_id, text ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
r AS (SELECT a.doc_id, a.text, a.pos, min(b.pos) AS last FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.text = b.text AND b.pos >= a.pos AND b.till - a.since >= 50 GROUP BY a.doc_id, a.text, a.pos
UNION SELECT b.doc_id, b.text, max(a.pos), b.pos FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.text = b.text AND b.pos >= a.pos AND b.till - a.since >= 50 GROUP BY b.doc_id, b.text, b.pos),
n AS (SELECT r.doc_id, r.text, r.pos, r.last, md5(string_agg(p.line, chr(10) ORDER BY p.pos)) AS run FROM r JOIN p ON p.doc_id = r.doc_id AND p.text = r.text AND p.pos BETWEEN r.pos AND r.last GROUP BY r.doc_id, r.text, r.pos, r.last),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, text, pos) AS copy FROM n),
g AS (SELECT DISTINCT f.doc_id, f.text, p.line_no FROM f JOIN p ON p.doc_id = f.doc_id AND p.text = f.text AND p.pos BETWEEN f.pos AND f.last WHERE copy > 1),
k AS (SELECT a.doc_id, a.text, count(g.line_no) AS n_gone, coalesce(string_agg(CAST(g.line_no AS VARCHAR), ',' ORDER BY g.line_no), '') AS gone_lines, coalesce(string_agg(a.line, chr(10) ORDER BY a.line_no) FILTER (WHERE g.line_no IS NULL), '') AS kept
FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.text = a.text AND g.line_no = a.line_no GROUP BY a.doc_id, a.text)
SELECT o.doc_id, CAST(coalesce(len(string_split(o.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_gone, coalesce(gone_lines, '') AS gone_lines, CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5
FROM documents o LEFT JOIN k ON k.doc_id = o.doc_id AND k.text = o.text"""

OP5_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id"""

OP7_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_WORDS = f"list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP10_SQL = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, least(13, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
m AS (SELECT DISTINCT m FROM g),
x AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS pos FROM d JOIN m ON len(w) >= m),
h AS (SELECT doc_id, x.m, pos, item FROM (SELECT doc_id, m, pos, array_to_string(w[pos:pos + m - 1], ' ') AS g FROM x) x JOIN g USING (m, g)),
k AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + m)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN k USING (doc_id) LEFT JOIN i USING (doc_id)"""


_CAPITALS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


#: crc32 of the decimal id, bit by bit (the polynomial of the standard, reflected).
_CRC32 = """4294967295 - list_reduce([4294967295::BIGINT] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

#: t and u: nodes of the sources' trees and of the tree over them; s: each node's siblings; f: the fold along them.
OP11_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql(_CAPITALS)} AS low, coalesce(({_CRC32}) % 5 = 0, FALSE) AS changed FROM documents),
p AS (SELECT doc_id, leaf, CASE WHEN changed THEN low ELSE leaf END AS claimed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT tree, 0 AS level, idx, n, leaf AS h FROM p
UNION ALL SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY tree, level, idx // 16, n),
u AS (SELECT 0 AS level, tree AS idx, (SELECT count(DISTINCT tree) FROM p) AS n, h FROM t WHERE n = 1
UNION ALL SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 16, n),
s AS (SELECT tree, level, idx, coalesce(string_agg(h, '') OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
FROM (SELECT tree, level, idx, n, h FROM t UNION ALL SELECT -1, level, idx, n, h FROM u) WHERE n > 1 WINDOW k AS (PARTITION BY tree, level, idx // 16 ORDER BY idx)),
e AS (SELECT p.tree, p.idx, s.level AS step, a, b FROM p JOIN s ON s.tree = p.tree AND s.idx = p.idx // CAST(pow(16, s.level) AS BIGINT)
UNION ALL SELECT p.tree, p.idx, 1000 + s.level, a, b FROM p JOIN s ON s.tree = -1 AND s.idx = p.tree // CAST(pow(16, s.level) AS BIGINT)),
o AS (SELECT *, row_number() OVER (PARTITION BY tree, idx ORDER BY step) AS nth FROM e),
f AS (SELECT tree, idx, CAST(0 AS BIGINT) AS nth, claimed AS h FROM p UNION ALL SELECT f.tree, f.idx, o.nth, sha256(o.a || f.h || o.b) FROM f JOIN o ON o.tree = f.tree AND o.idx = f.idx AND o.nth = f.nth + 1),
g AS (SELECT tree, idx, arg_max(h, nth) AS folded FROM f GROUP BY tree, idx),
q AS (SELECT tree, idx, string_agg(a || b, '' ORDER BY nth) AS proof FROM o GROUP BY tree, idx)
SELECT p.doc_id, p.leaf, t.h AS subroot, u.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, g.folded AS folded_root, g.folded = u.h AS verified
FROM p JOIN t ON t.tree = p.tree AND t.n = 1 JOIN u ON u.n = 1 JOIN g ON g.tree = p.tree AND g.idx = p.idx LEFT JOIN q ON q.tree = p.tree AND q.idx = p.idx"""


def _assigned_sql(books: str) -> str:
    """Nearest entry and squared distance of each part, packed as distance * 64 + entry."""
    return f"""SELECT vec_id, part, any_value(x) AS x, min(d * 64 + entry) AS best FROM (SELECT vec_id, p.part, x, entry,
CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM p JOIN {books} b ON b.part = p.part) GROUP BY vec_id, part"""


def _means_sql(found: str, books: str) -> str:
    return f"""SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY pos) AS c
FROM (SELECT part, best % 64 AS entry, pos, sum(x[pos]) AS s, count(*) AS n FROM {found}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM p))) AS pos) WHERE pos <= len(x) GROUP BY part, best % 64, pos) GROUP BY part, entry) m
ON m.part = b.part AND m.entry = b.entry"""


OP12_SQL = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[len(v) * part // 16 + 1:len(v) * (part + 1) // 16] AS x FROM v, (SELECT unnest(range(16)) AS part)),
c0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
a1 AS MATERIALIZED ({_assigned_sql("c0")}), c1 AS MATERIALIZED ({_means_sql("a1", "c0")}),
a2 AS MATERIALIZED ({_assigned_sql("c1")}), c2 AS MATERIALIZED ({_means_sql("a2", "c1")}),
a3 AS MATERIALIZED ({_assigned_sql("c2")}),
r AS (SELECT vec_id, string_agg(format('{{:02x}}', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256 FROM r JOIN v USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force, exact round trips or held-out accuracy in ``tests/llm``."""
    return {"op4_line_dedup": OP4_SQL, "op5_ngram_join": OP5_SQL, "op7_exact_topk": OP7_SQL, "op10_decontaminate": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_vector_codes": OP12_SQL}
