"""Stages keep tables whose columns are called like the stages' own, and decontamination is the same without a broadcast."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from boardlake.llm import chat, common, decontaminate, linededup, partenum, quality, repair, rules, trie, vectors
from tests.llm import plain

SF = "/root/testdata/sf0.001"
MODULES = (chat, common, decontaminate, linededup, partenum, quality, repair, rules, trie, vectors)
NAMES = sorted({n.lower() for m in MODULES for n in re.findall(r"[\"'](_\w+)[\"']", inspect.getsource(m))} | {f"_max_{m}" for m in rules.METRICS} | {"kept", "counts", "metric", "value", "m", "n", "x", "d", "y"})


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").cache()


@pytest.fixture(scope="module")
def clashing(sample):
    return sample.select("*", *[F.lit(f"clash {n}").alias(n) for n in NAMES]).cache()


def _texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("stage", ["rules", "lines", "join", "benchmark"])
def test_stages(spark, sample, clashing, stage):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    run = {"rules": rules.keep_good, "lines": linededup.dedup, "join": partenum.keep_one, "benchmark": lambda d: decontaminate.remove(d, bench)}[stage]
    out = run(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == _texts(run(sample))
    assert all(r[n] == f"clash {n}" for r in rows[:5] for n in NAMES)


def test_training(spark, sample, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    one, two = (quality.train(d, labels.select("*", *[F.lit(0).alias(n) for n in NAMES])) for d in (sample, clashing))
    texts = ["some words here", "", "& & & &"]
    assert one.score(texts).tolist() == two.score(texts).tolist()


def test_a_fit_is_bounded_by_passages_of_whole_texts(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (50 + i)) for i in range(40)] + [(3, "another text of this id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert quality.train(docs, labels) is not None
    assert quality.train(docs, labels, passages=1) is None


def test_decontamination_without_a_broadcast(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    many = docs.filter("doc_id < 80").unionByName(docs.limit(1).select(F.lit(9_000).cast("long").alias("doc_id"), F.lit(bench.first().text).alias("text"), "lang", "source", "n_chars"))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    found = {r.doc_id: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate.report(many, bench).collect()}
    want = plain.op2([(r.doc_id, r.text) for r in many.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert found == want
    assert any(v[4] for v in want.values())
