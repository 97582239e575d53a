"""Quality rules, hard negatives and resampling against brute-force versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelinekit.llm import common, negatives, ngrams, quality, queries, resampling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, weight long, row string, places string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "x" * 60_000), (5, "a b c d e " * 6_000), (6, "#*$ %& |<> " * 40), (7, "é Ü 𝒳 ñ\n\n é Ü 𝒳 ñ\n" * 9),
        (8, "one two three"), (8, "one two three"), (None, "n o t h i n g a b c d e f g h i j k l m"), (None, None),
        (9, " ".join(f"w{i}" for i in range(30_000))), (10, "same line\nsame line \nsame line\n\n\nother\nother\nother"),
    ]
    return spark.createDataFrame([(i, t, 0.5, 7, "r", "p") for i, t in texts] + [(11, "A Z a z " * 10, 0.5, 7, "r", "p")] * 5, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def given(spark, name):
    return common.table(spark, SF, name)


def both(spark, awkward):
    return given(spark, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))


def crc(text):
    return zlib.crc32(text.encode())


# 11 quality rules
def _surface(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    seen = Counter(windows)
    inside = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(found)
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def _quality(docs, labels, buckets, lost):
    def grams(text):
        b = [crc(w) % buckets for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return b + [(x * quality.PAIR_FACTOR + y) % buckets for x, y in zip(b, b[1:])]

    label = {}
    for i, q in labels:
        label[i] = min(q or 0, label.get(i, 1))
    trusted = {i for i, q in label.items() if q == 1 and i is not None}
    all_grams = [(i, grams(t)) for i, t in docs]
    s = Counter(b for _, g in all_grams for b in g)
    t = Counter(b for i, g in all_grams if i in trusted and crc(str(i)) % 2 == 0 for b in g)
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in range(buckets)]
    scores = [math.floor(sum(gain[b] for b in g) / len(g)) if g else None for _, g in all_grams]
    judges = sorted(x for (i, _), x in zip(docs, scores) if i in trusted and crc(str(i)) % 2 and x is not None)
    threshold = max((x for x in judges if sum(y < x for y in judges) * 1000 <= len(judges) * lost), default=None)
    if not any(i in trusted and crc(str(i)) % 2 == 0 for i, _ in docs):
        threshold = None
    out = Counter()
    for (i, text), x in zip(docs, scores):
        base = _surface(text)
        out[(i, *base, x, not base[-1] and (threshold is None or (x is not None and x >= threshold)))] += 1
    return out


def test_quality(spark, awkward, empty):
    labels = given(spark, "labels").select("doc_id", "quality", F.lit("x").alias("score"))
    more = spark.createDataFrame([(9, 1, "x"), (9, 1, "x"), (5, 1, "x"), (5, 0, "x"), (None, 1, "x"), (10, None, "x")], "doc_id long, quality int, score string")
    labels = labels.unionByName(more)
    docs = both(spark, awkward)
    rows, marks = [tuple(r) for r in docs.collect()], [tuple(r)[:2] for r in labels.collect()]
    for lost in (10, 200):
        got = quality.quality(docs, labels, 500, lost)
        assert Counter(tuple(r) for r in got.collect()) == _quality(rows, marks, 500, lost)
    assert Counter(tuple(r) for r in quality.quality(awkward, labels.limit(0)).collect()) == _quality(rows[-awkward.count() :], [], quality.BUCKETS, 10)
    assert quality.quality(empty, labels).count() == 0


def test_quality_keeps_trusted_and_drops_bad(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_quality(spark, sf).filter("not base_failed").join(common.table(spark, sf, "labels"), "doc_id")
    kept = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] >= 0.98 and kept[0] <= 0.05


def test_repeated_words_of_overlapping_windows(spark):
    texts = ["a " * 5, "a " * 6, "a b c d e f a b c d e g", "a b c d e a b c d", "a b c d e a b c d e", "x " + "a b c d e f g " * 3 + "y", "1 2 3 4 5 6 7 8 9 10 1 2 3 4 5 5 6 7 8 9 10"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("found", ngrams.words(F.col("text"), quality.WORD))
    assert [r[0] for r in rows.select(quality.repeated_words(F.col("found"))).collect()] == [_surface(t)[4] for t in texts]


# 12 hard negatives
def _negatives(rows, every):
    found = set()
    for i, vec, label in rows:
        if i is None or label is None or not vec or any(x is None or not math.isfinite(x) for x in vec):
            continue
        found.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in vec)))
    out = Counter()
    for i, label, vec in found:
        if i % every:
            continue
        near = sorted((-sum(map(int.__mul__, vec, v)), j, other) for j, other, v in found if j != i and len(v) == len(vec))
        for minus, positive, _ in [x for x in near if x[2] == label][:5]:
            inside = [x for x in near if x[2] != label and 80 * -minus <= 100 * -x[0] <= 100 * -minus][:5]
            for n, (score, negative, _) in enumerate(inside):
                out[(i, positive, n + 1, negative, -minus, -score)] += 1
    return out


def test_hard_negatives(spark):
    e = given(spark, "embeddings")
    assert Counter(tuple(r) for r in negatives.hard_negatives(e).collect()) == _negatives([tuple(r) for r in e.collect()], 100)


def test_hard_negatives_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        dim = 3 if i % 50 == 49 else 18
        vec = [float(x) for x in rng.choice([-0.5, 0.25, 0.5, 1.0], dim)] if i % 3 else [0.5] * dim
        rows.append((i if i % 97 else None, vec, int(rng.integers(0, 4)) if i % 31 else None))
    rows += [(40, [0.5] * 18, 1)] * 3 + [(5, [], 1), (6, None, 1), (8, [None] * 18, 1), (9, [math.nan] * 18, 1), (11, [math.inf] * 18, 1), (20, [0.0] * 18, 3), (60, [0.3] * 18, 2)]
    rows += [(1000 + i, [1.0] * 18, 2) for i in range(200)]
    given_rows = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, key string, rank double")
    got = Counter(tuple(r) for r in negatives.hard_negatives(given_rows, every=20).collect())
    assert got == _negatives(rows, 20) and got
    assert negatives.hard_negatives(given_rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="2\\*\\*23"):
        negatives.hard_negatives(spark.createDataFrame([(100, [1e9], 1)], "vec_id long, embedding array<double>, label int")).collect()


def test_bounds_hold_at_every_level_and_rule_rows_out():
    rng = np.random.default_rng(2)
    for dim in (1, 5, 16, 50):
        a, b = rng.integers(-300, 300, (7, dim)), rng.integers(-300, 300, (60, dim))
        exact, widths = a @ b.T, []
        for count in negatives.LEVELS:
            low, high = negatives.score_bounds(*[negatives.at_level(negatives.summaries(x), dim, count) for x in (a, b)])
            assert (low <= exact).all() and (exact <= high).all()
            widths.append((high - low).mean())
        assert widths == sorted(widths, reverse=True)
    # clusters of nearly constant segments: almost nothing is left to score exactly
    centres = np.repeat(rng.integers(-200, 200, (40, 4)), 8, axis=1)
    rows = np.repeat(centres, 25, axis=0) + rng.integers(-2, 3, (1000, 32))
    tile = negatives.Tile(rows[:10], negatives.summaries(rows[:10]), rows, negatives.summaries(rows))
    scored = []
    exact_scores, negatives.exact_scores = negatives.exact_scores, lambda a, b, pairs=None: scored.append(len(pairs[0]) if pairs else len(a) * len(b)) or exact_scores(a, b, pairs)
    try:
        i, j, s = negatives.positives_in(tile, ~np.eye(10, 1000, dtype=bool), 5)
    finally:
        negatives.exact_scores = exact_scores
    want = np.sort(np.where(np.eye(10, 1000, dtype=bool), -(10**9), rows[:10] @ rows.T), axis=1)[:, -5:][:, ::-1]
    assert (s.reshape(10, 5) == want).all() and scored[0] < 0.1 * 10_000


# 13 resampling
def _resampled(docs, target, percent, longest, buckets, min_words, seed=2024):
    def words(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def features(found):
        return [crc(" ".join(found[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(found) - n + 1)]

    all_words = [(i, words(t)) for i, t in docs]
    hashed = [features(w) for _, w in all_words]
    s, t = Counter(b for f in hashed for b in f), Counter(b for x in target for b in features(words(x)))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in range(buckets)]
    rows = []
    for (i, w), f in zip(all_words, hashed):
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling(spark, awkward, empty):
    docs, target = both(spark, awkward), given(spark, "benchmark")
    rows, texts = [tuple(r) for r in docs.collect()], [r.text for r in target.collect()]
    for percent, longest, least in ((10, 1, 20), (37, 3, 3), (100, 1, 0), (0, 1, 20)):
        got = resampling.resample(docs, target, percent, longest, 1_000, least)
        assert Counter(tuple(r) for r in got.collect()) == _resampled(rows, texts, percent, longest, 1_000, least)
    assert resampling.resample(empty, target).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(awkward, target.limit(0)).collect()) == _resampled(rows[-awkward.count() :], [], 10, 1, 10_000, 20)


def test_resampling_settles_ties_by_id_and_then_by_row(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u"
    rows = [(1, text)] * 40 + [(None, text)] * 7 + [(2, text)] * 3 + [(3, "short")]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(text,)], "text string")
    for percent in (2, 50, 81, 99):
        got = resampling.resample(docs.repartition(4), target, percent)
        assert Counter(tuple(r) for r in got.collect()) == _resampled(rows, [text], percent, 1, 10_000, 20)


@pytest.mark.parametrize("values", [[5], [3, 3, 3], [-(10**9), 4, 4, 4, 4, 10**12], list(range(-50, 50)) + [7] * 30])
def test_bisection_finds_every_order_statistic(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values)
    for need in {1, len(values) // 2 + 1, len(values)}:
        v = ordered[need - 1]
        assert resampling.value_at(rows, "v", need) == (v, sum(x < v for x in values), values.count(v))
