"""Edits of entries, splits, and statistics of shots, steps and inserts, against sequential models."""

import itertools
import random
import statistics

from pyspark.sql import functions as F

from timelinekit.operators import camera, measure, timeline
from timelinekit.plans.layout import KeyLayout

ENTRY = "k long, id string, kind string, start_s double, end_s double, word_ids array<string>, text string, reason string"


def test_edited_entries(spark):
    pick = random.Random(5)
    entries, words, want = [], [], []
    for k, e in itertools.product(range(4), range(6)):
        entry = (k, f"u{e}", "cut", 10.0 * e, 10.0 * e + 9, ["w"], "whole text", "before")
        own = [(k, f"u{e}", i, 10.0 * e + i, 10.0 * e + i + 0.5, f"t{i}", None if i == 3 else f"w{i}", bool(pick.getrandbits(1)) if e > 2 else e == 1)
               for i in range(0 if e == 0 else 7)]
        entries.append(entry)
        words += own
        runs = [list(g) for _, g in itertools.groupby(own, key=lambda w: w[-1])]
        if not own:
            want.append(entry)
        elif len(runs) == 1:
            kept = runs[0][0][-1]
            want.append((k, f"u{e}", "keep" if kept else "cut", *entry[3:7], None if kept else "edit"))
        else:
            for n, run in enumerate(runs, 1):
                kept = run[0][-1]
                want.append((k, f"u{e}x{n}", "keep" if kept else "cut", run[0][3], run[-1][4], [w[6] for w in run if w[6]], " ".join(w[5] for w in run), None if kept else "edit"))
    pick.shuffle(words)
    rows = spark.createDataFrame(words, "k long, id string, pos int, start_s double, end_s double, text string, word_id string, stays boolean")
    got = timeline.edited_entries(spark.createDataFrame(entries, ENTRY), rows, KeyLayout(("k", "id"), "pos"), ["pos"], F.col("stays"), "word_id")
    by_id = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.select("k", "id", "kind", "start_s", "end_s", "word_ids", "text", "reason").collect()), key=by_id) == sorted(want, key=by_id)


def test_splits_partition_the_text(spark):
    entries = spark.createDataFrame([(1, f"u{i}", "keep", 0.0, 10.0, ["w1"], "aa bbb ccccc", None) for i in range(7)], ENTRY)
    asked = {
        "u0": [("aa", "a"), (" bbb ccccc ", None)], "u1": [("aa", "a")], "u2": [("aa", "a"), (" ", "b"), ("bbb ccccc", "c")],
        "u3": [("aa", "long-name"), ("bbb ccccc", "b")], "u4": [("aa", "a"), ("ccccc", "b")], "u5": [("bbb ccccc", "a"), ("aa", "b")], "u9": [("aa", "a"), ("b", "b")],
    }
    parts = spark.createDataFrame([(1, i, n, t, s) for i, p in asked.items() for n, (t, s) in enumerate(p, 1)], "k long, id string, part_no int, text string, suffix string")
    faults = {r.id: r.fault for r in camera.split_faults(entries, parts, ["k"]).collect()}
    assert faults == {
        "u0": None, "u1": "fewer than two parts", "u2": "empty part", "u3": "bad suffix", "u4": "parts differ from the text",
        "u5": "parts differ from the text", "u9": "unknown entry",
    }
    got = {r.id: (r.start_s, r.end_s, r.word_ids, r.text) for r in camera.apply_splits(entries, parts, ["k"]).collect()}
    cut = round(10 * 2 / 11, 6)
    assert got["u0a"] == (0.0, cut, ["w1"], "aa") and got["u0p2"] == (cut, 10.0, [], "bbb ccccc")
    assert sorted(got) == ["u0a", "u0p2", "u1", "u2", "u3", "u4", "u5", "u6"]


def test_statistics_of_series(spark):
    pick = random.Random(2)
    rows = [(k, float(t), pick.choice([None, 10.0, 10.5, 11.0, 40.0, 41.0])) for k in (1, 2) for t in range(60)] + [(3, 0.0, None), (3, 4.0, 10.0)]
    samples = spark.createDataFrame(rows, "k long, t double, y double")
    layout = KeyLayout(("k",), "t")
    inserts = {r.k: tuple(r)[1:] for r in measure.insert_profile(samples, layout, ["t"], "y").collect()}
    steps = {r.k: r for r in measure.step_summary(measure.scale_steps(samples, layout, ["t"], "y"), layout, ["t"]).collect()}
    for k in (1, 2, 3):
        series = [(t, y) for key, t, y in rows if key == k]
        runs, last = [], None
        for t, y in series:
            if y is not None and last is not None and abs(y - last) <= 2:
                runs[-1].append((t, y))
            elif y is not None:
                runs.append([(t, y)])
            last = y
        long = [r for r in runs if r[-1][0] - r[0][0] >= 1.5]
        lengths = [r[-1][0] - r[0][0] for r in long]
        middle = lambda v: round(statistics.median(v), 4) if v else None
        assert inserts[k] == (len(long), round(sum(lengths) / series[-1][0], 4), middle(lengths), middle([statistics.median(y for _, y in r) for r in long]))
        change = [(t, (y - was) / was * 100) for (_, was), (t, y) in itertools.pairwise(series) if y is not None and was is not None]
        jumps = [(t, c) for t, c in change if abs(c) > 8]
        if k < 3:
            s = steps[k]
            assert (s.steps, s.ups, s.downs) == (len(jumps), sum(c > 0 for _, c in jumps), sum(c < 0 for _, c in jumps))
            assert s.interval_s == middle([b - a for (a, _), (b, _) in itertools.pairwise(jumps)]) and s.size_pct == middle([abs(c) for _, c in jumps])
            assert s.smooth_pct == middle([abs(c) for _, c in change if 0.8 < abs(c) <= 8])
        else:
            assert k not in steps
    cuts = spark.createDataFrame([(1, 0.5), (1, 4.0)], "k long, t double")
    ends = spark.createDataFrame([(1, 9.0), (2, 3.0)], "k long, end_s double")
    shots = {r.k: tuple(r)[1:] for r in measure.shot_summary(measure.shot_lengths(cuts, ends, layout, "t"), ["k"]).collect()}
    assert shots == {1: (3, 3.5, 0.3333, 4.5), 2: (1, 3.0, 0.0, 3.0)}
