"""The pipeline's stages against what they must keep and drop."""

import re
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_hits

from eventspark.llm import mixing, ngram_join
from eventspark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(90001, "12 34 !!", "en", "s", 8), (90002, None, None, None, None), (90003, "", "en", "s", 0), (90004, None, "en", None, 1)], docs.schema)
    docs = docs.union(extra).union(docs.where("doc_id = 7"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs.collect()
        if name != "shard":
            assert docs.columns == corpus_pipeline.COLUMNS
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    kept = [r["doc_id"] for r in seen["language_id"]]
    assert Counter(kept) == Counter([*texts, 7])
    join = [r["doc_id"] for r in seen["ngram_join"]]
    assert len(join) == len(set(join)) == len({r["text"] for r in seen["ngram_join"]})
    assert {texts[i] for i in texts} >= {r["text"] for r in seen["ngram_join"]}
    clean = {r["doc_id"] for r in seen["decontaminate"]}
    assert clean <= set(join)
    mixed = Counter(r["doc_id"] for r in seen["mix"])
    assert set(mixed) <= clean and max(mixed.values()) <= 2
    assert Counter(r["doc_id"] for r in seen["shard"]) == mixed
    sizes = Counter()
    for r in seen["shard"]:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= max(len((t or "").encode()) for t in texts.values()) * 2
    for s in sizes:
        assert sorted(r["slot"] for r in seen["shard"] if r["shard"] == s) == list(range(sum(r["shard"] == s for r in seen["shard"])))


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_each_stage_keeps_what_it_must(spark):
    base = table(spark, SF, "documents")
    item = next(r["text"] for r in table(spark, SF, "benchmark").collect() if len(r["text"].split()) >= 20)
    long = " ".join(f"word{chr(97 + k % 26)}{k}" for k in range(60))
    extra = [(90003, "", "en", "s", 0), (90005, item, "en", "s", 1), (90006, long, "en", "s", 1), (90007, long + " end", "en", "s", 1), (90008, "un " + long, "en", "s", 1)]
    docs = base.union(spark.createDataFrame(extra, base.schema)).union(base.where("doc_id = 7"))
    bench = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    into = rows(docs)
    joined = corpus_pipeline.drop_near_duplicates(spark, docs, SF).cache()
    comps = brute_components([x[:2] for x in into])
    want = {x for x in into if comps[x[0]][1] == x[0]}
    assert Counter(rows(joined)) == Counter(want)
    assert {90006} == {x[0] for x in want} & {90006, 90007, 90008}
    clean = corpus_pipeline.drop_contaminated(spark, joined, SF).cache()
    bad = {x[0] for x in brute_hits([x[:2] for x in rows(joined)], bench) if x[5]}
    assert Counter(rows(clean)) == Counter(x for x in want if x[0] not in bad)
    assert 90005 in bad
    into = rows(clean)
    mixed = Counter(rows(corpus_pipeline.mix_to_weights(spark, clean, SF)))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in into}
    totals, taken = Counter(), Counter()
    for i, _, s in into:
        totals[s] += size[i]
    goal = mixing.water_fill(dict(totals))
    picked = {r["__key"]["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in mixing.mix_sources(corpus_pipeline._keyed(clean), id_col="__key").collect()}
    assert mixed == Counter({x: picked[x[0]] for x in into if picked[x[0]]})
    for (i, _, s), n in mixed.items():
        taken[s] += n * size[i]
    for s in totals:
        assert goal[s] * 0.98 - 5 <= taken[s] <= goal[s]
        copies = {n: [size[x[0]] for x in into if x[2] == s and size[x[0]] and mixed[x] == n] for n in range(3)}
        assert not (copies[0] and copies[2])


def test_long_texts_reach_python_in_bounded_batches(spark, tmp_path, monkeypatch):
    """400 texts of 40 kB in one task: all of them come, in batches of 2 MB and one text at most."""
    key, most, sign = "spark.sql.execution.arrow.maxBytesPerBatch", (2 << 20) + 50_000, ngram_join._sign
    base = table(spark, SF, "documents")
    text = F.concat(F.lit("the house and the river "), F.repeat(F.concat(F.lit("word"), F.col("id"), F.lit(" ")), 5000)).substr(1, 40_000)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(40_000).alias("n_chars"))
    docs = docs.select(*[F.col(f.name).cast(f.dataType) for f in base.schema])

    def watch(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    def watched_sign(*args):
        run = sign(*args)

        def noted(batches):
            for b in batches:
                with open(f"{tmp_path}/sizes", "a") as f:
                    f.write(f"{b.num_rows} {b.nbytes}\n")
                yield from run(iter([b]))

        return noted

    monkeypatch.setattr(ngram_join, "_sign", watched_sign)
    for stage in (corpus_pipeline.keep_known_languages, corpus_pipeline.drop_near_duplicates):
        spark.conf.unset(key)
        assert stage(spark, docs, SF).count() == 400
        seen = docs.mapInArrow(watch, "n long, bytes long").collect()
        assert sum(r["n"] for r in seen) == 400 and max(r["bytes"] for r in seen) <= most
    noted = [tuple(map(int, x.split())) for x in (tmp_path / "sizes").read_text().splitlines()]
    assert sum(n for n, _ in noted) == 400 and max(b for _, b in noted) <= most
    spark.conf.set(key, "1m")
    corpus_pipeline.keep_known_languages(spark, docs.limit(0), SF)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
