import importlib.util
import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from episodica.llm import quality
from episodica.llm.shared import staged
from tests.llm.test_jaccard import brute


@pytest.fixture(scope="module")
def source(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_against_plain_versions(spark, sf_dir, source):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = staged(stage(spark, docs, sf_dir), "test")
        seen[name] = before
        if name != names[-1]:
            assert docs.columns == source.columns and docs.dtypes == source.dtypes
    kept = {r.doc_id for r in quality.assess(source).collect() if r.kept}
    assert set(seen["n-gram Jaccard join"]) == kept
    groups = brute(list(seen["n-gram Jaccard join"].items()), 5, 80)
    assert set(seen["benchmark decontamination"]) == {i for i, c in groups.items() if i == c}
    assert set(seen["PII"]) <= set(seen["benchmark decontamination"])
    left = list(seen["packing"].items())
    assert {i for i, _ in left} == set(seen["PII"])
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", x or "") for _, x in left)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {i for i, _ in left}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_odd_rows(spark, sf_dir, make, odd, prose):
    docs = make(odd + [(30, prose(1, 200)), (30, prose(2, 200)), (31, prose(2, 200)), (None, prose(3, 200)), (None, prose(3, 200))])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = staged(out, "test")
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(None) == 2 and ids.count(30) == 1 and 31 not in ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(ids)


def test_registered():
    assert importlib.util.find_spec("episodica.llm") is not None
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
