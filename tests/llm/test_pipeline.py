"""The pipeline's stages on awkward documents and against brute force."""

from pyspark.sql import functions as F

import corpus_pipeline
from test_text_operators import base, near, words
from tickloom.llm import stages

FOLDER = "/root/testdata/sf0.001"


CLASHES = ["_key", "_row", "_text", "_before", "_stays", "_lang", "kept", "n_words", "rows", "group", "component_id", "shingle"]


def test_stages_take_awkward_documents(spark, awkward):
    """Nulls, very long texts, repeated rows, and columns named like the stages' own, whose values stay."""
    docs = awkward.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) AS long) n_chars", *[f"concat('{c}', doc_id) `{c}`" for c in CLASHES])
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.concat("text", F.lit(" api_key = abcdef0123456789 and more ordinary words that make it twenty"))))
    before = docs.collect()
    counts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        counts[name] = len(rows)
        if k == 4:
            assert len(rows) == len(before)
            continue
        assert out.columns == docs.columns
        if k != 3:  # rows as they were
            left = list(before)
            for r in rows:
                left.remove(r)
    # the long texts of one word are short or repetitive; the plain sentence has under twenty words, its longer form twice
    assert counts["quality rules"] == 2
    # of equal rows one stays; rows without words all do
    kept = stages.near_duplicates(spark, docs, FOLDER).collect()
    empty = lambda rows: sum(not words(r.text) for r in rows)
    assert empty(kept) == empty(before) and sum(r.doc_id == 1 for r in kept) == 2 and len(kept) == len(before) - 2
    assert counts["benchmark decontamination"] == len(before)
    scanned = stages.secret_scans(spark, docs, FOLDER).collect()
    masked = [r for r in scanned if r.text and "[SECRET]" in r.text]
    assert len(scanned) == len(before) and len(masked) == 2 and masked[0].n_chars == len(masked[0].text) and masked[0]._key == "_key1"
    plain = lambda rows: sorted(map(repr, (r for r in rows if not r.text or not any(x in r.text for x in ("SECRET", "api_key")))))
    assert plain(scanned) == plain(before)


def test_stages_keep_repeated_rows_without_words(spark, awkward):
    docs = awkward.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) AS long) n_chars").where("text IS NULL OR trim(text) = ''")
    docs = docs.unionByName(docs)
    assert stages.near_duplicates(spark, docs, FOLDER).count() == docs.count()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id: r for r in stages.quality_rules(spark, docs, FOLDER).collect()}
    ids = sorted(kept)
    group, _ = near([kept[i].text for i in ids], 5, 80)
    single = {ids[g] for g in set(group)}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i for i in single if not any(t in kept[i].text for t in items)}
    mix = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(mix) <= clean and len(clean) - len(mix) <= 0.02 * len(clean)  # edited items leave as well
    for i, r in mix.items():
        assert (r.size == len(words(kept[i].text))) or base(kept[i].text)
        assert 0 <= r.taken <= 3 * r.size
