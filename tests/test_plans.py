"""Skew-safe plans against small sequential models, on ordinary and on hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelinekit.plans.graph import connected_components
from timelinekit.plans.greedy import first_wins
from timelinekit.plans.layout import KeyLayout, lookup_join
from timelinekit.plans.ordered import islands, ordered_scan
from timelinekit.plans.quantiles import exact_percentiles, upper_median
from timelinekit.plans.ranges import merge_spans, overlap_join, point_join
from timelinekit.plans.thinning import thin

GAP = 0.25


def rows(seed=1, hot=150, cold=8):
    rng = random.Random(seed)
    out = []
    for k, n in ((1, hot), (2, cold), (3, cold), (4, 1)):
        t = 0.0
        for _ in range(n):
            t = round(t + rng.choice([0.0, 0.05, 0.1, 0.2, 0.3, 1.0]), 3)
            out.append((k, len(out), t, rng.choice([None, 1, 2, 5]), rng.randint(0, 9)))
    rng.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k int, id int, t double, v int, w int")


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return groups


def check_scan(spark):
    data = rows()
    df = frame(spark, data)
    layout = KeyLayout.measure(df, ["k"], "t")
    out = ordered_scan(
        df, layout, ["t", "id"], prev={"p": "v"}, nxt={"n": "id"}, before={"b": "w"}, upto={"u": "w"},
        max_before={"m": "w"}, last={"l": "v"}, coming={"c": "v"}, number="no",
    )
    got = {r["id"]: r for r in out.collect()}
    for group in by_key(data).values():
        for i, r in enumerate(group):
            g = got[r[1]]
            known = [x[3] for x in group[: i + 1] if x[3] is not None]
            ahead = [x[3] for x in group[i:] if x[3] is not None]
            assert g["p"] == (group[i - 1][3] if i else None)
            assert g["n"] == (group[i + 1][1] if i + 1 < len(group) else None)
            assert g["b"] == sum(x[4] for x in group[:i])
            assert g["u"] == sum(x[4] for x in group[: i + 1])
            assert g["m"] == (max(x[4] for x in group[:i]) if i else None)
            assert g["l"] == (known[-1] if known else None)
            assert g["c"] == (ahead[0] if ahead else None)
            assert g["no"] == i + 1
    return layout


def test_scan_plain(spark):
    assert not check_scan(spark).split


def test_scan_hot(spark, tiny_limit):
    assert check_scan(spark).split


def test_scan_hot_orders_of_any_type(spark, tiny_limit):
    data = rows()
    df = frame(spark, data).withColumn("s", F.format_string("t%09.3f", "t")).withColumn("at", F.timestamp_millis(F.round(F.col("t") * 1000).cast("long")))
    want = {r[1]: i + 1 for group in by_key(data).values() for i, r in enumerate(group)}
    for order in ("s", "at"):
        layout = KeyLayout.measure(df, ["k"], order)
        assert layout.split
        got = {r["id"]: r["no"] for r in ordered_scan(df, layout, [order, "id"], number="no").collect()}
        assert got == want


def test_cuts_follow_each_key(spark):
    df = spark.range(3000).selectExpr("0 as k", "id as t").union(spark.range(1000).selectExpr("cast(1 + id % 10 as int)", "id"))
    layout = KeyLayout.measure(df, ["k"], "t", limit=50)
    chunks = {}
    for r in layout.tag(df).groupBy("k", "_chunk").count().collect():
        chunks.setdefault(r["k"], []).append(r["count"])
    assert 30 <= len(chunks[0]) <= 61 and max(chunks[0]) <= 250
    assert all(len(c) <= 3 for k, c in chunks.items() if k)


def check_islands(spark):
    data = rows(2)
    df = frame(spark, data)
    layout = KeyLayout.measure(df, ["k"], "t")
    out = islands(df, layout, ["t", "id"], F.col("t") - F.col("was") > GAP, prev={"was": "t"})
    got = {r["id"]: r["island"] for r in out.collect()}
    for group in by_key(data).values():
        run = 0
        for i, r in enumerate(group):
            run += 1 if i == 0 or r[2] - group[i - 1][2] > GAP else 0
            assert got[r[1]] == run


def test_islands_plain(spark):
    check_islands(spark)


def test_islands_hot(spark, tiny_limit):
    check_islands(spark)


def greedy(times, gap, at_least=False):
    kept = []
    for t in times:
        far = not kept or (round(t * 1e6) - round(kept[-1] * 1e6) >= round(gap * 1e6) if at_least
                           else round(t * 1e6) - round(kept[-1] * 1e6) > round(gap * 1e6))
        if far:
            kept.append(t)
    return kept


def check_thin(spark, data, gap, at_least=False):
    df = frame(spark, data)
    layout = KeyLayout.measure(df, ["k"], "t")
    out = thin(df, layout, ["t", "id"], gap, at_least).collect()
    got = {}
    for r in out:
        got.setdefault(r["k"], []).append(r["t"])
    for k, group in by_key(data).items():
        assert sorted(got[k]) == greedy([r[2] for r in group], gap, at_least)


def test_thin_case(spark):
    data = [(1, i, t, 1, 1) for i, t in enumerate([0, 0.1, 0.2, 0.3, 0.6])]
    check_thin(spark, [(k, i, float(t), v, w) for k, i, t, v, w in data], 0.25)


def test_thin_plain(spark):
    check_thin(spark, rows(3), GAP)
    check_thin(spark, rows(3), 0.3, at_least=True)


def test_thin_hot(spark, tiny_limit):
    check_thin(spark, rows(4), GAP)


def test_thin_hot_dense(spark, tiny_limit):
    # No natural break for 120 samples: the pointer-doubling branch decides.
    rng = random.Random(5)
    data = [(1, i, round(i * 0.05 + rng.random() * 0.04, 4), 1, 1) for i in range(120)]
    data += [(2, 500 + i, float(i), 1, 1) for i in range(5)]
    check_thin(spark, data, 0.33)
    check_thin(spark, data, 0.25, at_least=True)


def check_quantiles(spark):
    data = rows(6)
    df = frame(spark, data)
    out = exact_percentiles(df, ["k"], "t", {"a": 0.1, "b": 0.5, "c": 0.97, "d": 1.0}).collect()
    middle = {r["k"]: r["median"] for r in upper_median(df, ["k"], "t").collect()}
    for r in out:
        values = sorted(x[2] for x in data if x[0] == r["k"])
        assert r["n"] == len(values)
        for name, p in (("a", 10), ("b", 50), ("c", 97), ("d", 100)):
            assert r[name] == pytest.approx(np.percentile(values, p), abs=1e-9)
        assert middle[r["k"]] == values[len(values) // 2]


def test_quantiles_plain(spark):
    check_quantiles(spark)


def test_quantiles_hot(spark, tiny_limit):
    check_quantiles(spark)


def check_first_wins(spark, seed):
    rng = random.Random(seed)
    data = [(i, f"k{rng.randint(0, 12)}", f"u{rng.randint(0, 25)}", rng.randint(0, 30)) for i in range(120)]
    data += [(200 + i, "k0", "u0", rng.randint(0, 30)) for i in range(60)]
    df = spark.createDataFrame(data, "id int, key string, url string, at int").repartition(5)
    got = {r["id"] for r in first_wins(df, "id", ["key", "url"], [-F.col("at")]).collect()}
    seen, kept = set(), set()
    for i, key, url, _ in sorted(data, key=lambda r: (-r[3], r[0])):
        if key in seen or url in seen:
            continue
        seen |= {key, url}
        kept.add(i)
    assert got == kept


def test_first_wins(spark):
    check_first_wins(spark, 7)
    df = spark.createDataFrame([(3, "x", "1", 9), (2, "x", "2", 8), (1, "y", "2", 7)], "id int, key string, url string, at int")
    assert {r["id"] for r in first_wins(df, "id", ["key", "url"], [-F.col("at")]).collect()} == {3, 1}


def test_first_wins_hot(spark, tiny_limit):
    check_first_wins(spark, 8)


def check_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    edges += [(200, 201 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if a != b:
            parent[max(ra, rb)] = min(ra, rb)
    for a, b in edges:
        if a != b:
            assert got[a] == find(a) and got[b] == find(b)


def test_components(spark):
    check_components(spark)


def test_components_hot(spark, tiny_limit):
    check_components(spark)


def test_lookup_join_hot(spark, tiny_limit):
    left = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 100), (3, 101)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    got = {(r["k"], r["v"], r["s"]) for r in lookup_join(left, right, ["k"], "left").collect()}
    assert len(got) == 62 and (3, 101, None) in got and (1, 59, "a") in got
    assert lookup_join(left, right, ["k"], "inner").count() == 61


def check_merge(spark):
    rng = random.Random(10)
    spans = [(k, s, s + rng.random() * 3) for k in (1, 2) for s in [rng.random() * 60 for _ in range(60)]]
    df = spark.createDataFrame(spans, "k int, s double, e double")
    got = sorted((r["k"], r["s"], r["e"]) for r in merge_spans(df, KeyLayout.measure(df, ["k"], "s"), ("s", "e")).collect())
    want = []
    for k in (1, 2):
        for s, e in sorted((s, e) for kk, s, e in spans if kk == k):
            if want and want[-1][0] == k and s <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(want[-1][2], e))
            else:
                want.append((k, s, e))
    assert got == want


def test_merge(spark):
    check_merge(spark)


def test_merge_hot(spark, tiny_limit):
    check_merge(spark)


def test_range_joins(spark):
    rng = random.Random(11)
    a = [(1, i, s, s + rng.random() * 4) for i, s in enumerate(rng.random() * 50 for _ in range(40))]
    b = [(1, i, s, s + rng.random() * 9) for i, s in enumerate(rng.random() * 50 for _ in range(40))]
    left = spark.createDataFrame(a, "k int, i int, s double, e double")
    right = spark.createDataFrame(b, "k int, j int, rs double, re double")
    got = sorted((r["i"], r["j"]) for r in overlap_join(left, right, ["k"], ("s", "e"), ("rs", "re"), 2.5).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])
    got = sorted((r["i"], r["j"]) for r in point_join(left, right, ["k"], "s", ("rs", "re"), 2.5).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if y[2] <= x[2] <= y[3])
