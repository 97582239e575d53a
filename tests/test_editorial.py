"""Similarity, takes and cross-segment groups against brute force and stated cases."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from timelinekit.functions.arrow import _distance, _lcs
from timelinekit.operators import cross as cr
from timelinekit.operators import editorial as ed
from timelinekit.operators import verify as vf
from timelinekit.plans.layout import KeyLayout

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def lines(seed, n=70):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(5, 14))] for _ in range(8)]
    out = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(WORDS)
        out.append((1 + i % 2, f"u{i:04d}", float(i), " ".join(text)))
    return out


def ratio(a, b):
    return SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()


def brute_clusters(data, threshold):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(data):
        for b in data[i + 1:]:
            if a[0] == b[0] and ratio(a[3], b[3]) >= threshold:
                parent[find(b[1])] = find(a[1])
    groups = {}
    for node in parent:
        groups.setdefault(find(node), []).append(node)
    return {frozenset(g): max(g) for g in groups.values() if len(g) > 1}


def check_clusters(spark, seed):
    data = lines(seed)
    df = spark.createDataFrame(data, "k int, id string, start_s double, text string").repartition(3)
    out = ed.repeat_clusters(df, ["k"], "start_s", 0.8).collect()
    got, kept = {}, {}
    for r in out:
        got.setdefault((r["k"], r["component"]), set()).add(r["id"])
        if r["kept"]:
            kept[(r["k"], r["component"])] = r["id"]
    assert {frozenset(v): kept[c] for c, v in got.items()} == brute_clusters(data, 0.8)


def test_repeat_clusters(spark):
    check_clusters(spark, 1)


def test_repeat_clusters_hot(spark, tiny_limit):
    check_clusters(spark, 2)


def test_repeat_pairs_complete(spark):
    data = lines(3)
    df = spark.createDataFrame(data, "k int, id string, start_s double, text string")
    pairs = ed.repeat_pairs(df, ["k"], "start_s", 0.8).collect()
    first = {}
    for k, _, at, text in data:
        first.setdefault((k, text), at)
    want = set()
    for i, a in enumerate(data):
        for b in data[i + 1:]:
            if a[0] == b[0] and a[3] != b[3] and ratio(a[3], b[3]) >= 0.8:
                want.add((a[0], frozenset((first[(a[0], a[3])], first[(b[0], b[3])]))))
    assert {(r["k"], frozenset((r["a_first_at"], r["b_first_at"]))) for r in pairs} == want


def brute_groups(data, similar, minimum):
    def score(x, y):
        a, b = set(x.split()), set(y.split())
        return min(ratio(x, y), len(a & b) / max(len(a), len(b)))

    rows = sorted((r for r in data if len(r[3].split()) >= minimum), key=lambda r: (int(r[0]), r[2]))
    taken, groups = set(), []
    for i, anchor in enumerate(rows):
        if anchor[1] in taken:
            continue
        group = [anchor]
        for other in rows[i + 1:]:
            if other[1] in taken or other[0] in {g[0] for g in group}:
                continue
            if min(score(other[3], g[3]) for g in group) >= similar:
                group.append(other)
        if len(group) > 1:
            groups.append(frozenset(g[1] for g in group))
            taken |= {g[1] for g in group}
    return set(groups)


def test_cross_groups(spark):
    for seed in (4, 5):
        rng = random.Random(seed)
        data = [(str(rng.randint(1, 5)), i, n, t) for n, (_, i, _, t) in enumerate(lines(seed, 50))]
        data += [(str(1 + n % 3), f"c{n:03d}", 100 + n, "one two three four five six") for n in range(11)]
        df = spark.createDataFrame([("p", *r) for r in data], "p string, seg string, id string, ordinal int, text string")
        out = cr.cross_group_matches(df.repartition(3), ["p"], "seg", "ordinal").collect()
        got = {}
        for r in out:
            got.setdefault((r["component"], r["group_no"]), set()).add(r["id"])
        assert {frozenset(v) for v in got.values()} == brute_groups(data, 0.84, 5)


def test_cross_case(spark):
    same = "the money does not leave because you spend it"
    df = spark.createDataFrame([("p", "01", "a", 0, same), ("p", "02", "b", 0, same)], "p string, seg string, id string, ordinal int, text string")
    out = cr.cross_group_matches(df, ["p"], "seg", "ordinal")
    assert {(r["id"], r["kept"]) for r in out.collect()} == {("a", False), ("b", True)}
    films = df.select("p").distinct()
    assert cr.keep_continuity(out, films, ["p"]).first()["verdict"] == "BLOCKED"


def test_explicit_takes_and_absorb(spark):
    rows = [("m", "u1", 0.0, 1.0, "intro one", "intro"), ("m", "u2", 1.2, 2.0, "intro two", "intro"), ("m", "u3", 4.0, 5.0, "next", None)]
    df = spark.createDataFrame(rows, "k string, id string, start_s double, end_s double, text string, take_group string")
    got = {r["id"]: r["kept"] for r in ed.explicit_takes(df, ["k"], "take_group", "start_s").collect()}
    assert got == {"u1": False, "u2": True}
    entries = spark.createDataFrame(
        [("m", "a", 0.0, 1.0, "Cut this.", "cut", "proposed-take"), ("m", "b", 1.0, 2.0, "and the tail", "keep", None),
         ("m", "c", 2.0, 3.0, "more tail", "keep", None), ("m", "d", 3.0, 4.0, "New thought", "keep", None),
         ("m", "e", 4.0, 5.0, "Cut", "cut", "false-start"), ("m", "f", 5.0, 6.0, "stays here", "keep", None)],
        "k string, id string, start_s double, end_s double, text string, kind string, reason string",
    )
    out = ed.absorb_tails(entries, KeyLayout(("k",), "start_s"), ["start_s"], F.lit(False)).collect()
    assert {(r["id"], r["kind"], r["end_s"]) for r in out} == {("a", "cut", 3.0), ("d", "keep", 4.0), ("e", "cut", 5.0), ("f", "keep", 6.0)}


def test_markers_in_cyrillic(spark):
    df = spark.createDataFrame([("Давайте ЗАНОВО, ещё раз",), ("По моим наблюдениям деньги уходят. Деньги уходят не потому",), ("Обычная фраза",)], "text string")
    out = df.select(ed.retake_marker(F.col("text")), ed.take_prefix(F.col("text")), ed.false_cohesion(F.col("text"))).collect()
    assert [r[0] for r in out] == [True, False, False]
    assert out[1][1] == "по моим наблюдениям деньги уходят" and [r[2] for r in out] == [False, True, False]


def test_merge_incomplete_stops_at_marker(spark):
    rows = [("m", "u1", 0.0, 1.0, "Мы начали,", "keep"), ("m", "u2", 1.1, 2.0, "потом заново", "keep"), ("m", "u3", 2.1, 3.0, "и дальше", "keep"),
            ("m", "u4", 3.1, 4.0, "до конца.", "keep"), ("m", "u5", 4.1, 5.0, "и точка", "keep")]
    df = spark.createDataFrame(rows, "k string, id string, start_s double, end_s double, text string, decision string")
    out = ed.merge_incomplete(df, KeyLayout(("k",), "start_s"), ["start_s"]).orderBy("start_s").collect()
    # u2 holds the marker itself and is not joined; the marker then blocks u3 from joining it.
    assert [(r["id"], r["parts"]) for r in out] == [("u1", 1), ("u2", 1), ("u3", 2), ("u5", 1)]


def test_bit_parallel_programs():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        edits = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
                edits[i][j] = min(edits[i - 1][j] + 1, edits[i][j - 1] + 1, edits[i - 1][j - 1] + (x != y))
        assert _lcs(a, b) == table[-1][-1] and _distance(a, b) == edits[-1][-1]


def test_verification_cases(spark):
    df = spark.createDataFrame([(list("abcdefghi"), list("abcdefghx"))], "expected array<string>, actual array<string>")
    row = vf.wer_metrics(df).first()
    assert (row["wer"], row["order_ratio"], row["edit_distance"]) == (0.111111, 0.888889, 1)
    assert df.select(vf.levenshtein_tokens(F.col("expected"), F.col("actual"))).first()[0] == 1
    echo = spark.createDataFrame([("работа руками работа руками потом".split(),)], "t array<string>").select(vf.ngram_echoes(F.col("t"))).first()[0]
    assert echo == [0]
    late = spark.createDataFrame([(["a", "b", "c"], [0.0, 1.0, 2.0], ["x", "a", "c"], [0.1, 1.2, 4.0])], "e array<string>, ea array<double>, a array<string>, aa array<double>")
    row = vf.timing_drift(late, "e", "ea", "a", "aa").first()
    assert (row["compared"], row["over_threshold"], row["max_drift_s"], row["median_drift_s"]) == (2, 2, 2.0, 2.0)
