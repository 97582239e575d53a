"""What Spark may broadcast: rows multiplied by an explode are many more than it reckons with."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelinekit.llm import nearest, negatives, simhash


def broadcast_explodes(df) -> list[str]:
    """The exploding steps that stand below a broadcast in the plan of ``df``."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = at
        elif depth is not None and "Generate explode" in line:
            found.append(line.strip())
    return found


@pytest.fixture()
def plans(monkeypatch):
    """All tables that a module saves, in order."""
    seen = []

    def watch(module):
        saved = module.saved
        monkeypatch.setattr(module, "saved", lambda df, label: seen.append(df) or saved(df, label))
        return seen

    return watch


def _vectors(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(n)]
    return spark.createDataFrame(rows + [(n + 7, rows[20][1], 1)], "vec_id long, embedding array<float>, label int")


def test_queries_meet_shards_without_being_multiplied(spark, plans):
    made = plans(nearest)
    found = nearest.nearest(_vectors(spark, 300), every=5, k=4, shard_nodes=40)
    assert not [x for df in [*made, found] for x in broadcast_explodes(df)]
    # one broadcast of packed queries however many shards there are
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()


def test_hits_do_not_depend_on_passes_and_tasks(spark, monkeypatch):
    vectors = _vectors(spark, 300)
    rows = lambda: sorted(tuple(r) for r in nearest.nearest(vectors, every=5, k=4, shard_nodes=40).collect())
    whole = rows()
    monkeypatch.setattr(nearest, "PACKED_QUERIES", 7)
    monkeypatch.setattr(nearest, "BROADCAST_BLOCKS", 2)
    assert rows() == whole and len(whole) == 60 * 4


def test_anchors_meet_rows_without_being_multiplied(spark, plans):
    made = plans(negatives)
    found = negatives.hard_negatives(_vectors(spark, 300), every=5)
    assert not [x for df in [*made, found] for x in broadcast_explodes(df)]
    assert all("Generate explode" not in df._jdf.queryExecution().executedPlan().toString() for df in [*made, found])


def test_negatives_do_not_depend_on_passes_and_blocks(spark, monkeypatch):
    vectors = _vectors(spark, 300)
    rows = lambda: sorted(tuple(r) for r in negatives.hard_negatives(vectors, every=5).collect())
    whole = rows()
    for name, value in (("ROW_COMPONENTS", 320), ("ANCHOR_COMPONENTS", 80), ("BROADCAST_BLOCKS", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert rows() == whole and whole


def test_salted_rows_are_not_broadcast(spark, plans):
    made = plans(simhash)
    docs = spark.createDataFrame([(i, f"one two three four five six word{i // 4}") for i in range(40)], "doc_id long, text string")
    found = simhash.near_duplicates(docs)
    simhash.copy_representatives(docs, F.col("doc_id")).collect()
    assert sum("Generate explode" in df._jdf.queryExecution().executedPlan().toString() for df in [*made, found]) > 3
    assert not [x for df in [*made, found] for x in broadcast_explodes(df)]
