from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import tiktoken
from barloom.llm import bpe, jaccard, mixing, quality, secrets
from pyspark.sql import functions as F


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).filter("kept").collect()}
    first = corpus_pipeline.quality_rules(spark, docs, sf).cache()
    assert {r["doc_id"] for r in first.collect()} == kept and first.columns == docs.columns
    clash = corpus_pipeline.quality_rules(spark, docs.withColumn("kept", docs["lang"]), sf)
    assert clash.count() == len(kept) and clash.filter("kept <> lang").isEmpty()
    unique = corpus_pipeline.near_duplicates(spark, first, sf).cache()
    comps = jaccard.components(first).collect()
    assert {r["doc_id"] for r in unique.collect()} == {r["component_id"] for r in comps}
    clean = corpus_pipeline.secret_scan(spark, unique, sf).cache()
    assert clean.count() == unique.count() and clean.columns == docs.columns
    assert secrets.digests(clean).filter("n_assign + n_access + n_hex > 0").isEmpty()
    mixed = corpus_pipeline.source_mix(spark, clean, sf).cache()
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(clean).collect() if r["taken"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want and mixed.columns == docs.columns
    last = corpus_pipeline.run(spark, sf).collect()
    assert len(last) == sum(want.values())
    ranks = bpe.text_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encoder.ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = {r["doc_id"]: len(library.encode_ordinary(r["text"])) for r in clean.collect()}
    assert all(r["n_tokens"] == count[r["doc_id"]] for r in last)


NEAR = " ".join(f"w{i}" for i in range(200))
OTHER = " ".join(f"o{i}" for i in range(60))
CLASH = ("t", "n", "id", "own", "label", "spans", "rules", "kept", "score", "_kept", "_trusted", "_id", "_h", "_c", "_t", "_text", "_words", "size", "of", "copies", "x0", "c0", "m0")


def odd_documents(spark):
    """Repeated ids with several texts, repeated rows, nulls, empty and long texts, and columns of names used inside."""
    rows = [(3, NEAR), (5, OTHER), (5, NEAR + " z"), (5, OTHER), (None, NEAR), (None, None), (None, None), (7, ""), (8, None), (9, "long " * 30000 + "password: Abcdef123456789"), (10, OTHER.upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def same_columns(frame, out):
    assert out.columns == frame.columns
    assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASH)


def test_one_document_of_each_group_with_repeated_ids(spark, sf):
    frame = odd_documents(spark)
    out = corpus_pipeline.near_duplicates(spark, frame, sf)
    same_columns(frame, out)
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:8]) for r in out.collect())
    assert got == sorted([("3", NEAR[:8]), ("5", OTHER[:8]), ("None", ""), ("7", ""), ("8", ""), ("9", "long lon")])


def test_stages_on_odd_rows(spark, sf):
    frame = odd_documents(spark)
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.secret_scan, corpus_pipeline.source_mix):
        same_columns(frame, stage(spark, frame, sf))
        assert stage(spark, frame.limit(0), sf).count() == 0
    clean = corpus_pipeline.secret_scan(spark, frame, sf)
    assert clean.count() == frame.count() and clean.filter("doc_id = 9").first()["text"].endswith("long [SECRET]")
    assert clean.filter("text is null").count() == 3
    digests = corpus_pipeline.byte_bpe(spark, frame, sf)
    assert digests.count() == frame.count() and corpus_pipeline.byte_bpe(spark, frame.limit(0), sf).count() == 0
