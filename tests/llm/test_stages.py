"""Every pipeline stage on odd rows and on an empty table."""

import pytest

import corpus_pipeline
from .odd import documents

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_bears_odd_rows(spark, sf, name):
    docs = documents(spark)
    out = STAGES[name](spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    before = [tuple(r) for r in docs.collect()]
    assert all(tuple(r)[: len(docs.columns)] in before for r in out.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_bears_an_empty_table(spark, sf, name):
    assert STAGES[name](spark, documents(spark).limit(0), sf).count() == 0


def test_five_stages_in_the_order_asked():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
