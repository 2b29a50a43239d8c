"""Every pipeline stage on its own input, against brute force."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_jaccard import brute as components_of
from tests.llm.test_repeats import brute as repeats_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "suffix_array_dedup", "decontamination", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = stage["quality_classifier"](spark, docs, SF)
    rows = sorted(good.collect(), key=lambda r: r["doc_id"])
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows}
    assert good.columns == docs.columns and sum(quality[d] == 1 for d in quality if d not in kept) <= 2

    texts = [r["text"] for r in rows]
    roots = components_of(texts)
    single = sorted(stage["jaccard_join"](spark, good, SF).collect(), key=lambda r: r["doc_id"])
    assert single == [r for i, r in enumerate(rows) if roots[i][2] == i]

    rest = sorted(stage["suffix_array_dedup"](spark, spark.createDataFrame(single, docs.schema), SF).collect(), key=lambda r: r["doc_id"])
    removed = [r[1] for r in repeats_of([r["text"] for r in single])]
    assert [r["doc_id"] for r in rest] == [r["doc_id"] for r in single]
    for before, after, gone in zip(single, rest, removed, strict=True):
        size = len(before["text"].encode()) - gone
        assert size - 6 <= len(after["text"].encode()) <= size and after["n_chars"] == len(after["text"])

    df = spark.createDataFrame(rest, docs.schema)
    clean = stage["decontamination"](spark, df, SF).collect()
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in rest if any(i in " ".join(r["text"].lower().split()) for i in items)}
    assert {r["doc_id"] for r in rest} - {r["doc_id"] for r in clean} >= leaked
    packed = stage["best_fit_packing"](spark, spark.createDataFrame(clean, docs.schema), SF).collect()
    words = {}
    for r in packed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_tokens"]
    assert words == {r["doc_id"]: len(r["text"].split()) for r in clean}


def test_registered(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0
