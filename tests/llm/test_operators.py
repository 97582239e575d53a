"""Each operator against a brute-force version, on given tables and on awkward rows."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from timelinekit.llm import common, decontamination, language, mixing, nearest, pii, queries, simhash, token_counts, token_output, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, block string, fp string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    texts = [
        (1, "The idiot, the clown! Mail a.b@c.de%d@e.fg now"), (2, None), (3, ""), (4, " \n\t "), (5, "x" * 40_000), (6, "9" * 20_000),
        (7, "one two"), (7, "one two"), (None, "one two"), (None, None), (8, "ünï 𝒳 a@b.co 1.2.3.4.5 +1 (017) 555-7713 4111 1111 1111 1111"),
        (9, "a b c d e f " * 3_000), (10, "a b c d e f " * 3_000), (11, "GB82 WEST 1234 5698 7654 32 call 555-123-4567 ssn 123-45-6789"),
    ]
    rows = [(i, t, None if (i or 0) % 4 == 3 else "en", None if (i or 0) % 5 == 2 else "s", None, 9.0, "b", "f") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def given(spark, name):
    return common.table(spark, SF, name)


def both(spark, awkward):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    return given(spark, "documents").select(*names).unionByName(awkward.select(*names))


# 1 archives
def test_archives_round_trip(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "z" * 300_000, "<p>é</p>", "once"]
    rows = [(i, f"http://a/{i} \r\n", h, "x") for i, h in enumerate(html)] + [(None, None, "<p>é</p>", "x"), (None, None, "lone", "x"), (3, "u", "<p>é</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and not [r.error for r in got if r.error]
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h, _ in rows:
        data = (h or "").encode()
        least = first.get(h or "")
        revisit = i != least
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", least if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    none = warc.round_trip(pages.limit(0))
    assert none.count() == 0


def test_archives_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(i, "u", "ab") for i in range(3)], "page_id long, url string, html string")
    assert {r.record_type for r in warc.round_trip(pages, min_revisit_bytes=3).collect()} == {"response"}


def test_archive_reader_takes_dictionaries_and_reports_damage():
    records = [warc.record(i, f"http://h/{i}", b"<p>some text %d</p>" % i * 20, None, False) for i in range(300)]
    data = warc.train_dictionary(records)
    assert data
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data))
    frames = [packer.compress(r) for r in records]
    for stored in (data, zstandard.ZstdCompressor().compress(data)):
        archive = struct.pack("<II", warc.DICTIONARY_MAGIC, len(stored)) + stored + b"".join(frames)
        assert list(warc.frames(archive)) == records
    assert isinstance(list(warc.frames(archive[:-3]))[-1], ValueError)
    assert isinstance(list(warc.frames(archive + b"junk"))[-1], ValueError)
    bad = records[0].replace(b"Content-Length: ", b"Content-Length: 1", 1)
    for broken in (bad, records[0][:-1], records[0].replace(b"WARC/1.1", b"WARC/9"), records[0].replace(b"some", b"same", 1), records[0].replace(b"WARC-Date", b"Date")):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


# 2 mixing
def _edf(quotas):
    total, done, won = sum(quotas), [0] * len(quotas), []
    for t in range(total):
        ready = [(-(-(d + 1) * total // q), i) for i, (q, d) in enumerate(zip(quotas, done)) if d < q and d * total // q <= t]
        _, i = min(ready)
        assert min(ready)[0] >= t + 1  # every deadline is met
        done[i] += 1
        won.append(i)
        for q, d in zip(quotas, done):
            assert abs(d - q * (t + 1) / total) < 1
    return won


def test_mixing_follows_the_schedule(spark):
    sizes = {"a": 70, "b": 23, None: 9, "c": 1}
    rows = [(i, f"t{i}", s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "source string, weight int")
    got = mixing.mix(docs, weights, block_docs=2).collect()
    assert Counter(r.doc_id for r in got) == Counter([r[0] for r in rows] + [0, 1])
    sizes["a"] += 2
    order = sorted(sizes, key=lambda s: (s is not None, s))
    blocks = {s: -(-sizes[s] // 2) for s in order}
    weight = {"a": 5, "b": 3, "c": 2, None: 1}
    want, k = [], 0
    while any(blocks[s] > k * weight[s] for s in order):
        quotas = [max(0, min(weight[s], blocks[s] - k * weight[s])) for s in order]
        want += [order[i] for i in _edf([q for q in quotas]) ] if all(quotas) else [[s for s, q in zip(order, quotas) if q][i] for i in _edf([q for q in quotas if q])]
        k += 1
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.slot, []).append(r)
    assert [by_slot[i][0].source for i in range(len(by_slot))] == want
    for rows_ in by_slot.values():
        assert len({(r.source, r.block) for r in rows_}) == 1 and sorted(r.nth for r in rows_) == list(range(len(rows_)))
    assert mixing.mix(docs.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("slot", F.lit(1)))


def test_mixing_query_keeps_every_row_within_a_block_of_its_share(spark):
    got = queries.op2_mixing(spark, SF).toPandas()
    docs = given(spark, "documents").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    starts = got[got.nth == 0].sort_values("slot")
    assert starts.slot.tolist() == list(range(len(starts)))
    for _, one in starts.groupby("round"):
        quota = one.source.value_counts()
        for source, q in quota.items():
            passed = (one.source == source).cumsum().to_numpy()
            assert (np.abs(passed - q / len(one) * np.arange(1, len(one) + 1)) < 1).all()


# 3 decontamination
def test_decontamination(spark):
    items = [
        (1, "A train leaves Berlin at 60 km per hour and reaches Paris after 12 hours, how far apart are the two towns on the map?"),
        (2, "A train leaves Berlin at 60 km per hour and reaches Paris after 12 hours, how far apart are the two towns on the map?"),
        (3, "tiny"), (4, None), (5, "the quick fox jumps twice"),
    ]
    changed = items[0][1].replace("Berlin", "Oslo").replace("60", "75").replace("Paris", "Rome").replace("12", "9").replace("km", "mi")
    mixed = "A train leaves Oslo at 75 km per hour and reaches Oslo after 75 hours, how far apart are the two towns on the map?"
    texts = [(10, "before. " + items[0][1] + " after"), (11, changed), (12, mixed), (13, None), (14, ""), (15, "a train leaves town at noon " * 50),
             (16, "well. The quick fox jumps twice. yes"), (None, changed), (11, changed), (17, "x" * 50_000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, width int, hash int")
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, benchmark).collect()}
    assert found == {(10, 1), (11, 1), (16, 5), (None, 1)}
    assert decontamination.matches(docs.limit(0), benchmark).count() == 0
    assert decontamination.matches(docs, benchmark.limit(0)).count() == 0
    # without the hash filter the join finds the same
    before, decontamination.FILTER_WINDOWS = decontamination.FILTER_WINDOWS, -1
    try:
        assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs, benchmark).collect()} == found
    finally:
        decontamination.FILTER_WINDOWS = before


def test_decontamination_judges_each_occurrence_and_finds_verbatim_copies(spark):
    train = "A train leaves Berlin at 60 km per hour and reaches Paris after 12 hours, how far apart are the two towns on the map?"
    variant = train.replace("Berlin", "Oslo").replace("60", "75").replace("Paris", "Rome").replace("12", "9")
    mixed = variant.replace("Rome", "Oslo").replace(" 9 ", " 75 ")
    heavy = "Maria Jose Lopez, 12 34 56 78 90 11, Anna Berta Clara Dora 13 14 15 16"
    items = [(1, train), (2, heavy), (3, "Blue Whale Song"), (4, "Berlin grew faster than all of its neighbours"), (5, "?!")]
    texts = [
        "Here. " + train + " And now. " + variant, train + " " + variant.replace("Oslo", "Bonn") + " " + variant.replace("75", "80"),
        "see " + heavy.lower() + " there", "they heard the blue whale song today", "we know that Berlin grew faster than all of its neighbours did",
        "Here. " + mixed + " And now. " + mixed, "see Maria Jose 12 34 there", "blue song of a whale",
        # an inserted word, beside another variant
        train.replace("how far", "so how far") + " x" * 60 + ". " + variant,
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontamination.matches(docs, benchmark).collect())
    assert found == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (8, 1)]


def test_decontamination_query_finds_embedded_items(spark):
    docs, items = given(spark, "documents").toPandas(), given(spark, "benchmark").toPandas()
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, SF).collect()}
    held = {(d.doc_id, i.item_id) for d in docs.itertuples() for i in items.itertuples() if i.text in d.text}
    assert held <= got
    for doc_id, item_id in got - held:
        words = set(docs.text[docs.doc_id == doc_id].iloc[0].split())
        own = items.text[items.item_id == item_id].iloc[0].split()
        assert sum(w in words for w in own) >= 0.5 * len(own)


# 4 token counts
def test_token_counts(spark, awkward, empty):
    scores = token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    unknown = min(scores.values()) - token_counts.BYTE_PENALTY

    def count(word):
        text = "▁" + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            n = len(text[end - 1].encode())
            options = [(best[end - 1][0] + unknown * n, -(best[end - 1][1] + n))]
            options += [(best[at][0] + scores[text[at:end]], -(best[at][1] + 1)) for at in range(max(0, end - 20), end) if text[at:end] in scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    docs = both(spark, awkward)
    got = Counter((r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs, scores).collect())
    known = {}
    want = Counter()
    for r in docs.collect():
        words = (r.text or "").split()
        for w in words:
            known.setdefault(w, None)
        want[(r.doc_id, len(words), sum(known[w] if known[w] is not None else known.__setitem__(w, count(w)) or known[w] for w in words))] += 1
    assert got == want
    small = token_counts.Trie(scores)
    shared = [small.count(w) for w in ("part", "party", "partition")]
    assert shared == [count(w) for w in ("part", "party", "partition")] and len(small.best) == 2 + len("partition") + 1
    assert token_counts.token_counts(empty, scores).count() == 0


# 5 nearest neighbours
def _exact(rows, every, k):
    good = [(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and len(v) == len(rows[0][1])
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = sorted(set(good))
    out = {}
    for q, v in good:
        if q % every == 0:
            scores = {}
            for i, w in good:
                if i != q:
                    s = float(np.dot(np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)))
                    scores[i] = max(s, scores.get(i, -9e9))
            out[q] = sorted((-round(s, 9), i) for i, s in scores.items())[:k]
    return out


def test_nearest_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(100, 140)] + [rows[5], (200, None), (201, [0.0] * 8), (202, [1.0] * 3), (None, rows[1][1])]
    rows += [(203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, [None] + [1.0] * 7)]
    vectors = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = defaultdict(list)
    for r in nearest.nearest(vectors, every=20, k=20, shard_nodes=16).collect():
        got[r.query_id].append((r["rank"], -round(r.score, 9), r.vec_id))
    want = _exact(rows, 20, 20)
    assert {q: [(s, v) for _, s, v in sorted(x)] for q, x in got.items()} == want
    few = nearest.nearest(vectors.filter("vec_id < 5"), every=2, k=20).collect()
    assert Counter(r.query_id for r in few) == {0: 4, 2: 4, 4: 4}
    assert nearest.nearest(vectors.limit(0)).count() == 0


def test_nearest_recall(spark):
    vectors = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    got = defaultdict(set)
    for r in nearest.nearest(vectors, every=20, k=20, shard_nodes=700).collect():
        got[r.query_id].add(r.vec_id)
    data = vectors.toPandas().sort_values("vec_id")
    all_ = np.stack(data.embedding).astype(np.float64)
    ids = data.vec_id.to_numpy()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = all_ @ all_[i]
        s[i] = -np.inf
        true = ids[np.lexsort((ids, -s))[:20]]
        hits += len(got[ids[i]] & set(true.tolist()))
        total += 20
    assert hits / total >= 0.97


# 6 language
def test_language(spark, awkward, empty):
    docs = both(spark, awkward)
    got = language.identify(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    letterless = Counter(r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or ""))
    assert Counter(r.doc_id for r in got if r.lang_pred == "und") == letterless
    assert language.identify(empty).count() == 0
    nolabel = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nolabel.collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    joined = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    right = joined.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.95


def test_language_words_of_mixed_text(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    labeller = language.Labeller(language.fit(docs))
    one = {r.lang: r.text for r in docs.groupBy("lang").agg(F.min_by("text", F.abs(F.length("text") - 600)).alias("text")).collect()}
    parts = {k: language.WORD.findall(t.lower())[:60] for k, t in one.items()}
    langs = sorted(parts)
    post, _ = labeller.word_posteriors([" ".join(w for k in langs for w in parts[k])])
    truth = [labeller.chain.langs.index(k) for k in langs for _ in parts[k]]
    assert (post.argmax(axis=1) == truth).mean() > 0.8


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    k, lengths = 3, [5, 1, 140]
    move, start = rng.normal(size=(k, k)), rng.normal(size=k)
    scores = rng.normal(size=(sum(lengths), k))
    first = np.zeros(sum(lengths), dtype=bool)
    first[[0, 5, 6]] = True
    got = language.posteriors(scores, first, move, start)
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        alpha, beta = [start + s[0]], [np.zeros(k)]
        for i in range(1, n):
            alpha.append(np.log(np.exp(alpha[-1][:, None] + move).sum(0)) + s[i])
        for i in range(n - 2, -1, -1):
            beta.append(np.log(np.exp(move + (s[i + 1] + beta[-1])[None]).sum(1)))
        post = np.exp(np.array(alpha) + np.array(beta[::-1]))
        post /= post.sum(axis=1, keepdims=True)
        assert np.allclose(got[at : at + n], post)
        at += n


# 7 near-duplicates
def _fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = Counter(b for p, n in Counter(pieces).items() for h in [xxhash.xxh64_intdigest(p.encode(), 42)] for b in range(64) if h >> b & 1 for _ in range(n))
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(pieces))


def _groups(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    array = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4):
            parent[find(int(j))] = find(i)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(spark, awkward, empty):
    docs = both(spark, awkward)
    rows = docs.collect()
    prints = [_fingerprint(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], _groups(prints, [r.doc_id for r in rows])))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_of_dense_and_chained_fingerprints(spark):
    rng = np.random.default_rng(7)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 300)} | {0, (1 << 64) - 1}
    for centre in list(prints)[:3]:  # stars: a centre and what lies up to four bits around it
        for _ in range(200):
            prints.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    walk = int(rng.integers(0, 1 << 63))
    for _ in range(60):  # a chain of steps of four bits
        walk ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        prints.add(walk)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    label = {r.fp: r.component for r in simhash.link_components(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    mine = defaultdict(set)
    for p, s in zip(prints, signed):
        mine[label.get(s, s)].add(p)
    theirs = defaultdict(set)
    for p, g in zip(prints, _groups(prints, list(range(len(prints))))):
        theirs[g].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(1 << 63), 1 << 62, (200, 2))]
    rows = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("m")
    ).collect()
    for r in rows:
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        counts = [abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2)]
        assert r.m == sum(counts) <= (a ^ b).bit_count()


# 8 personal data
def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _base(text):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and _luhn(re.sub(r"\D", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    found = []
    for order, (kind, (pattern, good)) in enumerate(rules.items()):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if good(m.group())]
    return sorted(found)


EXTRA = [
    "a@b.c%d@e.f a@b..c x@y.z-1.q @@ a@b 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3.0000000255",
    "+1 (017) 555-7713 +49-30-1234567. +1 2 +12345678901234567 ++1234567890 4111-1111 1111 1111 4111111111111112 𝒳 +1 555 555 5555é",
    "é@a.b ü4111 1111 1111 1111x 1.1.1.1. 3 4 5", "1 1" * 4000, "a.b-c%" * 5000, "1." * 5000, "+1 " * 3000, "@a.b" * 2000,
]


def test_personal_data(spark, awkward, empty):
    extra = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(EXTRA)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = both(spark, awkward).union(extra)
    got, want = Counter(), Counter()
    for r in pii.personal_data(docs).collect():
        got[(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)] += 1
        assert r.spans.count(":") == 2 * (r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_iban + r.n_ssn + r.n_local_phone)
    for r in docs.collect():
        spans = _base(r.text or "")
        n = Counter(s[3] for s in spans)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want[(r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert got == want
    one = pii.personal_data(awkward.filter("doc_id = 11")).first()
    assert one.spans == "iban:0:27,local_phone:33:45,ssn:50:61"
    assert pii.personal_data(awkward.filter("doc_id = 11").withColumn("text", F.lit("number 555-123-4567 and 123-45-6789"))).first().spans == ""
    assert pii.personal_data(empty).count() == 0


def test_account_numbers_end_by_their_country(spark):
    texts = {
        "GB82 WEST 1234 5698 7654 32 BIC WESTGB2L": "iban:0:27", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": "iban:0:27",
        "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 10 PCS": "iban:0:27,iban:28:55",
        # what only looks like the start of a number hides none
        "REF NO12 DE89 3704 0044 0532 0130 00": "iban:9:36", "XX12 DE89 3704 0044 0532 0130 00 END": "iban:5:32",
        "DE89370400440532013000": "iban:0:22", "DE8937040044053201300": "", "DE89 3704 0044 0532 0130 001": "",
        "x NO9386011117947, NO93 8601 1117 947 AND MORE": "iban:2:17,iban:19:37",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ",".join(s for s in r.spans.split(",") if s.startswith("iban")) for r in pii.personal_data(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


# 9 toxicity
def test_toxicity(spark, awkward, empty):
    labels = given(spark, "labels")
    docs = both(spark, awkward)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert [r.predicted for r in toxicity.toxicity(awkward.filter("doc_id = 1"), labels).collect()] == [1]
    assert toxicity.toxicity(empty, labels).count() == 0
    unlabelled = toxicity.toxicity(awkward, labels.limit(0)).collect()
    assert {r.doc_id for r in unlabelled if r.predicted} == {1}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").filter("held_out").collect()
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in clean) == 0
    # some rows are labelled toxic without any word that tells; the others are found
    telling = [r for r in rows if r.toxic == 1 and set(toxicity.WORD.findall(r.text.lower())) & set(toxicity.INSULTS)]
    assert telling and all(r.predicted for r in telling)


def test_label_model_recovers_accuracies_and_shares_correlated_weight():
    rng = np.random.default_rng(11)
    truth = np.where(rng.random(4000) < 0.3, 1, -1)
    accuracy = [0.95, 0.8, 0.7, 0.65]
    votes = np.array([np.where(rng.random(4000) < a, truth, -truth) for a in accuracy]).T.astype(float)
    copies = np.repeat(votes[:, 3:], 4, axis=1)
    post, right, weight = toxicity.label_model(np.concatenate([votes, copies], axis=1))
    assert ((post > 0.5) == (truth > 0)).mean() > 0.9
    assert weight[3:].max() < 0.5 < weight[:3].min()
    assert abs(right[0] - 0.95) < 0.07 < right[0] - right[1]


# 10 token files
def test_codes_give_every_id():
    rng = np.random.default_rng(4)
    for ids in (np.array([], dtype=np.uint32), np.array([0, 255, 256, 65_535, 65_536, 2**32 - 1], dtype=np.uint32), rng.integers(0, 1 << 18, 5_000).astype(np.uint32)):
        codes = token_output.Codes.pack(ids)
        assert [codes.get(i) for i in range(len(ids))][:2000] == ids.tolist()[:2000]
        assert codes.slice(0, len(ids)).tolist() == ids.tolist()
        for _ in range(30 if len(ids) else 0):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert codes.slice(a, b).tolist() == ids[a:b].tolist()


def test_damaged_token_file_is_refused():
    data = token_output.segment(0, 0, [1, None], [2, 1], np.array([5, 2, 2], dtype=np.uint32))
    assert [d for _, _, d, _, _ in token_output.segments(data + b"\n" + data + b"\n")] == [[1, None], [1, None]]
    for broken in (data[:-2], data[:60] + b"?" + data[61:], b"x" + data):
        with pytest.raises(ValueError):
            list(token_output.segments(broken))


@pytest.mark.parametrize("segment_ids", [token_output.SEGMENT_IDS, 500])
def test_token_output(spark, awkward, empty, segment_ids):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(2000, "İSTANBUL ΣΑΣ x\x1cy z\xa0w é ﬁ don't <|endoftext|> </w> à ̀b")], "doc_id long, text string")
    docs = both(spark, awkward).select("doc_id", "text").union(odd)
    got = token_output.decode(spark, token_output.encode(docs, path, 2, segment_ids=segment_ids)).toPandas()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = [model.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows]
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.n_tokens, got.ids_crc32)) == Counter(
        (-1 if r.doc_id is None else r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids)
    )
    got = got.sort_values("start")
    assert (got.start.diff().dropna().to_numpy() == got.n_tokens.to_numpy()[:-1]).all() and got.start.iloc[0] == 0
    assert got.doc_id.dropna().is_monotonic_increasing and got.doc_id.isna().tolist()[:2] == [True, True]
    assert token_output.decode(spark, token_output.encode(empty, path, 2)).count() == 0


def test_words_before_marks_are_encoded_as_a_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, encoder = Tokenizer.from_file(path), token_output.WordEncoder(path)
    words = ["BELEDİYESİ", "ÜNİVERSİTESİ", "İ", "istanbul", "Éa", "ΣΑΣ", "ﬁ", "ŉ", "ﷺ", "word"]
    for text in [w + mark for w in words for mark in ".,"] + [" ".join(w + "." for w in words)]:
        got = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert got == model.encode(text, add_special_tokens=False).ids, text


# the pipeline
def _near_groups(texts, ids):
    """``_groups`` of the fingerprints, with texts united whose five-word shingles have a similarity of 0.8 or more."""
    group = _groups([_fingerprint(t) for t in texts], ids)
    found = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in found]
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group


def test_pipeline(spark, tmp_path):
    docs = given(spark, "documents")
    labels = given(spark, "labels")
    model = toxicity.fit(docs, labels)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    kept = [r for r in rows if model.score(r.text) < 0.5]
    groups = _near_groups([r.text for r in kept], [r.doc_id for r in kept])
    kept = [r for r, g in zip(kept, groups) if r.doc_id == g]
    found = {r.doc_id for r in decontamination.matches(docs, given(spark, "benchmark")).collect()}
    kept = [r for r in kept if r.doc_id not in found]
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("start")
    assert sorted(got.doc_id) == sorted(r.doc_id for r in kept)
    mixed = mixing.mix_to_weights(docs.filter(F.col("doc_id").isin([r.doc_id for r in kept]))).toPandas().sort_values(["slot", "nth"])
    assert got.doc_id.tolist() == mixed.doc_id.tolist()
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]


def test_pipeline_stages_take_awkward_and_empty_rows(spark, awkward, empty):
    columns = corpus_pipeline.COLUMNS
    for table in (awkward, empty):
        docs = table.select(*columns)
        for name, stage in corpus_pipeline.STAGES:
            docs = common.saved(stage(spark, docs, SF), name)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        # the toxic row goes; of blank texts, of the three equal short ones and of the two equal long ones one stays
        want = [] if table is empty else [2, 5, 6, 7, 8, 9, 11]
        assert sorted(r.doc_id for r in docs.collect()) == want


def test_near_duplicate_stage_keeps_one_row_of_each_component(spark):
    rng = np.random.default_rng(7)
    text = lambda: " ".join(f"w{n}" for n in rng.integers(0, 10**6, 60))
    alone, pair, shared = [text() for _ in range(20)], [text(), text()], text()
    rows = [(None, t, "en", "s", 1) for t in alone] + [(7, t, "en", "s", 1) for t in pair]
    # copies: of a row with an id, of a row without one, and with nulls in other columns
    rows += [(9, shared, "en", "s", 1), (None, shared, "en", "s", 1), (9, shared, "en", "s", 1), (None, alone[0], "en", "s", 1), (None, alone[1], None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, t) for t in alone] + [(7, t) for t in pair] + [(9, shared)])
