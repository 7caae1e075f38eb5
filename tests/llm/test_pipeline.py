"""The stages of corpus_pipeline one after another."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import common

from .fixture import documents, empty, words


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    quality, single, clean, mixed = seen
    labels = {r.doc_id: (r.quality, r.toxic) for r in common.table(spark, sf_dir, "labels").collect()}
    good = {i for i, x in labels.items() if x == (1, 0)}
    assert len(good & quality.keys()) >= 0.97 * len(good)
    assert single.keys() <= quality.keys() and max(collections.Counter(t for t in single.values()).values()) == 1
    items = [words(r.text, True) for r in common.table(spark, sf_dir, "benchmark").collect()]
    inside = lambda t: any(" ".join(x) in " ".join(words(t, True)) for x in items)
    assert clean.keys() == {i for i, t in single.items() if i in clean or not inside(t)}
    assert not any(inside(t) for t in clean.values())
    assert mixed.keys() == clean.keys()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {i for r in rows for i in r.doc_ids} == mixed.keys()


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_stand_odd_rows_and_empty_tables(spark, sf_dir, which):
    """Nulls, repeated rows, long and empty texts, and columns with every name that a stage might use itself."""
    given = documents(spark).withColumns({c: F.lit(7) for c in ("bad_form", "toxic", "copies", "rate", "unit", "part", "h", "start")})
    docs = common.materialise(given if which == "odd" else empty(spark), "odd-docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialise(stage(spark, docs, sf_dir), f"odd-{name}")
        assert out.columns == docs.columns and (out.count() <= docs.count() or name == "mixing")
        if which == "odd":
            assert out.where("toxic <> 7 or bad_form <> 7 or x is null").count() == 0
        out.collect()
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0) == (which == "odd")


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
