"""Pairs of the file context are counted in as many partitions as they need."""

from pathlib import Path

import pytest

from tessera.plans import summaries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_partitions_grow_with_the_pairs(spark, monkeypatch):
    whole = sorted(map(tuple, summaries.file_context_rank(spark, str(DATA)).collect()))
    monkeypatch.setattr(summaries, "MOST_MET", 50)
    found = summaries.file_context_rank(spark, str(DATA))
    assert sorted(map(tuple, found.collect())) == whole and whole
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
