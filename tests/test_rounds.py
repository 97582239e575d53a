"""Groups in rounds, dyadic interval joins, bounded search, block correlation, the whole transcript check."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from timelinekit.operators import cross as cr
from timelinekit.operators import search as se
from timelinekit.operators import signal as sg
from timelinekit.operators import timeline as tl
from timelinekit.operators import verify as vf
from timelinekit.plans.layout import KeyLayout
from timelinekit.plans.ranges import overlap_join, point_join


# groups over segments
def pair_score(x, y):
    a, b = x.split(), y.split()
    ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
    return min(ratio, len(set(a) & set(b)) / max(len(set(a)), len(set(b))))


def sequential_groups(data, similar, recommended):
    """The rule walked row by row: {frozenset of ids: (confidence, kept id)}."""
    rows, taken, out = sorted(data, key=lambda r: (int(r[0]), r[2], r[1])), set(), {}
    for i, anchor in enumerate(rows):
        group = [anchor]
        if anchor[1] in taken:
            continue
        for other in rows[i + 1 :]:
            fits = other[1] not in taken and other[0] not in {g[0] for g in group}
            if fits and min(pair_score(other[3], g[3]) for g in group) >= similar:
                group.append(other)
        if len(group) > 1:
            taken |= {g[1] for g in group}
            lowest = round(min(pair_score(a[3], b[3]) for n, a in enumerate(group) for b in group[n + 1 :]), 6)
            out[frozenset(g[1] for g in group)] = (lowest, group[-1][1] if lowest >= recommended else None)
    return out


def check_groups(spark, data):
    df = spark.createDataFrame([("p", *r) for r in data], "p string, seg string, id string, ordinal int, text string")
    got, conf, kept = {}, {}, {}
    for r in cr.cross_group_matches(df.repartition(3), ["p"], "seg", "ordinal").collect():
        key = (r["component"], r["group_no"])
        got.setdefault(key, set()).add(r["id"])
        conf[key] = r["confidence"]
        assert r["status"] == ("recommended" if r["confidence"] >= 0.92 else "uncertain") and (r["kept"] is None) == (r["status"] == "uncertain")
        if r["kept"]:
            kept[key] = r["id"]
    assert {frozenset(v): (conf[k], kept.get(k)) for k, v in got.items()} == sequential_groups(data, 0.84, 0.92)


def variants(rng, words, n):
    """Near variants of one sentence: some pairs reach the limit, others don't."""
    texts = set()
    while len(texts) < n:
        out = list(words)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(out))
            out[at] = rng.choice(["x", "y", "z", out[at], words[0]])
        texts.add(" ".join(out))
    return sorted(texts)


def test_groups_of_a_mixed_component(spark):
    rng = random.Random(11)
    texts = variants(rng, "a b c d e f g h i j k l m n".split(), 9)
    data = [(str(rng.randint(1, 4)), f"u{n:02d}", n, rng.choice(texts)) for n in range(36)]
    check_groups(spark, data)


def test_groups_where_one_sentence_has_most_rows(spark):
    """A complete component is done at once, however many rows it has."""
    texts = ["one two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven other"]
    data = [(str(1 + n % 3), f"u{n:03d}", n, texts[(n // 7) % 2]) for n in range(90)]
    data += [("4", "v1", 1, "a b c d e f g"), ("5", "v2", 1, "a b c d e f g")]
    check_groups(spark, data)


# interval joins
def test_joins_of_mixed_lengths_need_no_width(spark):
    rng = random.Random(3)
    lengths = [0.0, 0.01, 1.0, 60.0, 3600.0, 30 * 86400.0]
    spans = lambda n, c: [(rng.randint(0, 1), f"{c}{i}", s := rng.choice([rng.uniform(-1e5, 3e6), 64.0 * rng.randint(0, 40)]), s + rng.choice(lengths)) for i in range(n)]
    a, b = spans(150, "a"), spans(150, "b")
    left = spark.createDataFrame(a, "k int, i string, s double, e double")
    right = spark.createDataFrame(b, "k int, j string, rs double, re double")
    got = Counter((r["i"], r["j"]) for r in overlap_join(left, right, ["k"], ("s", "e"), ("rs", "re")).collect())
    assert got == Counter((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    got = Counter((r["i"], r["j"]) for r in point_join(left, right, ["k"], "s", ("rs", "re")).collect())
    assert got == Counter((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] <= x[2] <= y[3])
    assert overlap_join(left, right.limit(0), ["k"], ("s", "e"), ("rs", "re")).count() == 0


def test_words_on_the_new_timeline(spark):
    entries = spark.createDataFrame(
        [("p", "u1", "keep", 0.0, 2.0, "one two", ["w1", "w2", "w9"]), ("p", "u2", "cut", 2.0, 4.0, "gone", ["w3"]),
         ("p", "u3", "keep", 4.0, 6.0, "Three, four!", []), ("p", "u4", "keep", 6.0, 7.0, "five", ["w5", "w4"])],
        "p string, id string, kind string, start_s double, end_s double, text string, word_ids array<string>",
    )
    words = spark.createDataFrame(
        [("p", "w1", 0.5, 1.0, "One"), ("p", "w2", 1.7, 2.1, "two."), ("p", "w3", 2.1, 3.0, "gone"), ("p", "w4", 6.2, 6.3, "…"), ("p", "w5", 6.5, 7.4, "five"),
         ("p", "w6", 4.1, 4.4, "unlisted"), ("p", "w9", 1.98, 2.6, "late")],
        "p string, word_id string, start_s double, end_s double, text string",
    )
    got = tl.rebase_words(entries, words, KeyLayout(("p",), "start_s"), ["start_s", "id"], "word_ids").collect()
    rows = sorted((r["id"], r["word_no"], r["source_word_id"], r["token"], round(r["start_s"], 6), round(r["end_s"], 6), r["timing"]) for r in got)
    assert rows == [
        ("u1", 1, "w1", "one", 0.5, 1.0, "source-words"), ("u1", 2, "w2", "two", 1.7, 2.0, "source-words"),
        ("u3", 1, None, "three", 2.0, 3.0, "even-slices"), ("u3", 2, None, "four", 3.0, 4.0, "even-slices"),
        ("u4", 1, "w5", "five", 4.5, 5.0, "source-words"),
    ]
    # by overlap alone, an entry also owns words it doesn't list
    free = tl.rebase_words(entries, words, KeyLayout(("p",), "start_s"), ["start_s", "id"]).filter("id = 'u3'").collect()
    assert [(r["source_word_id"], r["token"]) for r in free] == [("w6", "unlisted")]


# search
@pytest.mark.parametrize("frequent", [3, 12, 10_000])
def test_search_with_common_terms_equals_full_scoring(spark, frequent):
    rng = random.Random(frequent)
    pool = ["all"] + [f"c{i}" for i in range(3)] * 6 + [f"r{i}" for i in range(40)]
    assets = [(i, ["all"] * (i % 5 > 0) + rng.sample(pool, 2), " ".join(["all"] * (i % 3 == 0) + rng.sample(pool, 3))) for i in range(80)]
    queries = [(f"q{i}", " ".join(["all"] * (i % 4 > 0) + rng.sample(pool, rng.randint(0, 3)))) for i in range(40)]
    got = se.catalog_search(
        spark.createDataFrame(queries, "query_id string, query string"),
        spark.createDataFrame(assets, "asset_id int, tags array<string>, description string"), frequent=frequent,
    )
    want = set()
    for q, text in queries:
        terms = set(text.split())
        scored = []
        for i, tags, about in assets:
            t, d = len(terms & set(" ".join(tags).split())), len(terms & set(about.split()))
            if t + d:
                scored.append((-(3 * t + d), i, t, d))
        want |= {(q, i, t, d, -s, n + 1) for n, (s, i, t, d) in enumerate(sorted(scored)[:5])}
    assert {(r["query_id"], r["asset_id"], r["tag_hits"], r["text_hits"], r["score"], r["place"]) for r in got.collect()} == want


# signals
def test_correlation_by_blocks_and_windows(spark):
    rng = random.Random(5)
    left = [(k, i, rng.random()) for k in (1, 2) for i in range(-7, 60) if rng.random() < 0.9] + [(3, i, 1.0) for i in range(20)]
    right = [(k, i, rng.random()) for k in (1, 2, 3) for i in range(-3, 66) if rng.random() < 0.9]
    a, b = (spark.createDataFrame(x, "k int, i long, v double") for x in (left, right))
    marked = a.withColumn("parts", F.array_compact(F.array(F.lit("whole"), F.when(F.col("i") < 20, F.lit("early")))))
    got = {(r["k"], r["window"], r["lag"]): (r["overlap"], r["correlation"]) for r in sg.lag_correlation(marked, b, ["k"], "i", "v", 9, 5, "parts").collect()}
    want = {}
    for k in (1, 2, 3):
        other = {i: v for n, i, v in right if n == k}
        for part, below in (("whole", 10**9), ("early", 20)):
            for lag in range(-9, 10):
                pairs = [(v, other[i + lag]) for n, i, v in left if n == k and i < below and i + lag in other]
                if len(pairs) >= 5:
                    mx, my = (sum(p[c] for p in pairs) / len(pairs) for c in (0, 1))
                    sxy, sxx, syy = (sum((p[c] - m) * (p[d] - n) for p in pairs) for c, d, m, n in ((0, 1, mx, my), (0, 0, mx, mx), (1, 1, my, my)))
                    want[(k, part, lag)] = (len(pairs), sxy / (sxx * syy) ** 0.5 if sxx * syy > 1e-18 else -1.0)
    assert got.keys() == want.keys()
    for key, (n, r) in want.items():
        assert got[key][0] == n and abs(got[key][1] - r) < 1e-9
    plain = {(r["k"], r["lag"]): r["overlap"] for r in sg.lag_correlation(a, b, ["k"], "i", "v", 9, 5).collect()}
    assert plain == {(k, lag): n for (k, part, lag), (n, _) in want.items() if part == "whole"}


# the transcript check
def _plain(a, b):
    row = list(range(len(b) + 1))
    common = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0], before = row[0], i, 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            before, common[j] = common[j], before + 1 if x == y else max(common[j], common[j - 1])
    return row[-1], common[-1]


def transcript(text, shift=0.0):
    tokens = text.split()
    return tokens, [i * 0.4 + shift for i in range(len(tokens))], [i * 0.4 + 0.3 + shift for i in range(len(tokens))]


def check_all(spark, cases, **limits):
    rows = []
    for n, (expected, actual, clips) in enumerate(cases):
        rows.append((n, expected[0], expected[1], [c[0] for c in clips], [c[1] for c in clips], *actual))
    schema = "n int, expected array<string>, expected_at array<double>, clip_from array<double>, clip_to array<double>, actual array<string>, actual_at array<double>, actual_end array<double>"
    return {r["n"]: r for r in vf.verify_transcripts(spark.createDataFrame(rows, schema), **limits).collect()}


def test_the_whole_check_gives_its_reasons(spark):
    same, twelve = transcript("hello big world"), "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    gap = (same[0], [0.0, 0.4, 4.0], [0.3, 0.7, 4.3])
    retake = transcript("вместо твердой постоянной работы вместо того чтобы добежать")
    echo = transcript("ежедневная работа руками работа руками и упорство")
    late = (["hello", "world"], [2.5, 2.9], [2.8, 3.2])
    got = check_all(spark, [
        (same, same, []), (same, gap, []), (retake[0:2] and transcript("иначе"), retake, []), (retake, retake, []), (echo, echo, []),
        (late, late, [(0.0, 4.0)]), (late, late, [(2.0, 4.0), (9.0, 12.0)]), (transcript(twelve), transcript(twelve, 1.2), []), (same, ([], [], []), []),
        (transcript("one two three four five six"), transcript("one five six two three four"), []),
    ])
    texts = {n: list(r["reasons"]) for n, r in got.items()}
    say = vf.REASONS
    assert texts[0] == [] and got[0]["verdict"] == "PASS" and texts[1] == [say["gap"]] and got[1]["long_gaps"] == 1
    assert say["opener_actual"] in texts[2] and texts[3] == [say["opener_expected"]] and texts[4] == [say["echo"]]
    assert texts[5] == [say["lead_in"]] and got[5]["lead_ins"] == 1 and texts[6] == []
    assert texts[7] == [say["drift"]] and got[7]["compared"] == 12 and got[7]["max_drift_s"] == 1.2
    assert texts[8] == [say["empty"]] and got[8]["verdict"] == "FAIL"
    assert texts[9] == [say["wer"], say["order"]]


def test_distances_against_the_cell_by_cell_programs(spark):
    rng = random.Random(8)
    cases = [tuple(transcript(" ".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 70, 140])))) for _ in range(2)) + ([],) for _ in range(40)]
    got = check_all(spark, cases)
    for n, (a, b, _) in enumerate(cases):
        assert (got[n]["edit_distance"], got[n]["lcs"]) == _plain(a[0], b[0])


def test_openers_in_an_array_and_in_rows_agree(spark):
    rng = random.Random(9)
    texts = [[rng.choice("o p q x".split()) for _ in range(rng.randint(0, 25))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t array<string>")
    counted = {r[0]: r[1] for r in df.select("n", vf.opener_repeats(F.col("t"), ("o",), (("p", "q"),), 4)).collect()}
    rows = df.select("n", F.posexplode("t").alias("i", "w"))
    listed = Counter(r["n"] for r in vf.repeated_openers(rows, ["n"], "i", "w", ("o",), (("p", "q"),), 4).collect())
    assert counted == {n: listed[n] for n in range(len(texts))} and sum(counted.values()) > 20
