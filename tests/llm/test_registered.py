"""Registered queries and the pipeline."""

import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components
from test_queries import D, duck, rows  # noqa: F401

from hicweave.llm.common import materialise
from hicweave.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):  # noqa: F811
    assert rows(QUERIES[name](spark, D).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).fetchdf())


def packing_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_pipeline_of_odd_rows(spark, odd, none):
    """Nulls in any column, blank and very long texts, repeated rows, an empty table, and columns with clashing names."""
    pipeline = importlib.import_module("corpus_pipeline")
    for rows_ in (odd.unionByName(odd.limit(3).withColumn("doc_id", F.lit(None).cast("long"))), none):
        docs = rows_
        for k, (_, stage) in enumerate(pipeline.STAGES):
            columns, before = docs.columns, docs.count()
            docs = materialise(stage(spark, docs, ""), f"odd{k}")
            if k < len(pipeline.STAGES) - 1:
                assert docs.columns == columns and docs.count() <= before
    assert docs.count() == 0


def test_pipeline_stages_take_effect(spark):
    from hicweave.llm import jaccard, quality, secrets
    from hicweave.llm.common import table

    pipeline = importlib.import_module("corpus_pipeline")
    small = "/root/testdata/sf0.001"
    docs = table(spark, small, "documents").filter("doc_id < 90")
    columns = docs.columns
    kept = {r.doc_id for r in quality.judge(docs).select("doc_id", "kept").collect() if r.kept}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = materialise(stage(spark, docs, small), f"test{k}")
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        now = {r.doc_id: r for r in docs.collect()}  # of the packed ones, a piece of each
        if name == "quality rules":
            assert set(now) == kept
        if name == "n-gram Jaccard join":
            sets = {r.doc_id: jaccard.shingle_set(jaccard.words_of(r.text.encode()), 5) for r in before.collect()}
            found = brute_components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
            assert set(now) == {i for i, c in found.items() if i == c}
        if name == "substring dedup":
            first, want = {}, {}
            for r in sorted(before.collect(), key=lambda r: r.doc_id):
                w = (r.text or "").split()
                for p in range(len(w) - 12):
                    first.setdefault(tuple(w[p : p + 13]), r.doc_id)
                gone = {p + j for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < r.doc_id for j in range(13)}
                want[r.doc_id] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else r.text
            assert {i: r.text for i, r in now.items()} == want
            assert all(r.n_chars == len(r.text) for r in now.values())
        if name == "packing":
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(packing_vocabulary())
            ids = {r.doc_id: coder.encode(r.text or "", add_special_tokens=False).ids + [0] for r in before.collect()}
            pieces = {}
            for r in docs.collect():
                pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
            assert {i: [x for _, p in sorted(pieces[i]) for x in p] for i in pieces} == ids
        if name == "secret scans":
            assert not any(x.found_spans for x in secrets.scan(docs).collect())
            assert all(r.n_chars == len(r.text) for r in now.values())
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_every_packed_sequence_holds_all_sources(spark):
    """op2 and the pipeline's last stage: the mixture holds in each sequence, not just over many."""
    import corpus_pipeline
    from hicweave.llm import packing
    from hicweave.llm.common import table

    d = "/root/testdata/sf0.001"
    for out in (packing.query(spark, d), corpus_pipeline.packed(spark, table(spark, d, "documents"), d)):
        held = out.groupBy("sequence_id").agg(F.countDistinct("queue").alias("q"), F.sum("length").alias("n")).filter("n = 1024").agg(F.avg("q"), F.max("q")).collect()[0]
        assert held[0] > 0.9 * held[1] > 1
