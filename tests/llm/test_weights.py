"""Mixing by target weights against a schedule walked slot by slot."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelinekit.llm import common, mixing, queries


def schedule(blocks, weights):
    """Winners of all slots: earliest deadline first, windows from the weights of the sources that last."""
    left, won = list(blocks), []
    while any(left):
        live = [i for i, n in enumerate(left) if n]
        total, done, t = sum(weights[i] for i in live), dict.fromkeys(live, 0), 0
        while all(left[i] for i in live):
            ready = [(-(-(done[i] + 1) * total // weights[i]), i) for i in live if done[i] * total // weights[i] <= t]
            due, i = min(ready)
            assert due > t
            done[i], left[i], t = done[i] + 1, left[i] - 1, t + 1
            won.append(i)
            assert all(abs(done[j] - weights[j] * t / total) < 1 for j in live)
    return won


def mixed(spark, sizes, weights, block_docs):
    rows = [(n, f"t{n}", s) for n, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    given = None if weights is None else spark.createDataFrame([(s, w) for s, w in weights.items() if w], "source string, weight int")
    got = mixing.mix_to_weights(docs.repartition(3), given, block_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.slot, []).append(r)
    for held in slots.values():
        assert len({(r.source, r.block, r.round) for r in held}) == 1 and sorted(r.nth for r in held) == list(range(len(held)))
    for s in sizes:
        order = [slots[i][0].block for i in range(len(slots)) if slots[i][0].source == s]
        assert order == list(range(len(order)))
    return [slots[i][0].source for i in range(len(slots))]


@pytest.mark.parametrize("sizes, weights", [
    ({"a": 70, "b": 23, None: 9, "c": 1}, {"a": 5, "b": 3, "c": 2}),
    ({"a": 8, "b": 8, "c": 200}, {"a": 1, "b": 1, "c": 1}),
    ({"a": 300, "b": 2}, {"a": 400, "b": 1}),
    ({"only": 7}, {"only": 3}),
])
def test_slots_follow_the_windows_of_the_target_weights(spark, sizes, weights):
    order = sorted(sizes, key=lambda s: (s is not None, s))
    blocks = [-(-sizes[s] // 2) for s in order]
    want = [order[i] for i in schedule(blocks, [weights.get(s, 1) for s in order])]
    assert mixed(spark, sizes, weights, 2) == want


def test_every_prefix_is_within_a_block_of_the_target_while_sources_last(spark):
    won = mixed(spark, {"a": 8_000, "b": 2_000}, {"a": 725, "b": 275}, 16)
    end = min(len(won) - 1 - won[::-1].index(s) for s in ("a", "b"))
    passed = np.cumsum([s == "b" for s in won])[:end]
    assert (np.abs(passed - 0.275 * np.arange(1, end + 1)) < 1).all() and end == 453


def test_long_periods_are_solved_in_chunks(spark):
    sizes, weights = {"a": 900, "b": 500, "c": 40}, {"a": 601, "b": 350, "c": 20}
    assert sum(weights.values()) > 3 * mixing.CHUNK
    assert mixed(spark, sizes, weights, 1) == [list(sizes)[i] for i in schedule(list(sizes.values()), list(weights.values()))]


def test_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 50_000, "s", 5, "h", 2)] * 3 + [(None, None, None, None, None, None)], "doc_id long, text string, source string, n long, hash string, index int")
    got = mixing.mix_to_weights(docs, block_docs=2)
    assert got.columns == [*docs.columns, "block", "round", "slot", "nth"]
    assert Counter((r.doc_id, r.n, r.hash, r["index"]) for r in got.collect()) == Counter((r.doc_id, r.n, r.hash, r["index"]) for r in docs.collect())
    assert mixing.mix_to_weights(docs.limit(0)).count() == 0
    for name in mixing.ADDED:
        with pytest.raises(ValueError):
            mixing.mix_to_weights(docs.withColumn(name, F.lit(1)))


def test_the_query_follows_the_default_weights(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_mixing(spark, sf).toPandas()
    docs = common.table(spark, sf, "documents").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    sizes = docs.source.value_counts().sort_index()
    share = sizes.astype(float) ** mixing.EXPONENT
    weights = np.maximum(1, np.round(share / share.sum() * mixing.RESOLUTION)).astype(int)
    won = got[got.nth == 0].sort_values("slot").source.tolist()
    assert won == [sizes.index[i] for i in schedule([-(-n // 16) for n in sizes], weights.tolist())]
