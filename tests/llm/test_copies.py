"""Near copies by shared passages against all pairs of texts."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from timelinekit.llm import common, simhash


def shingles(text, n=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at, how = rng.randrange(len(out)), rng.random()
        out[at : at + 1] = [] if how < 0.3 else [f"n{rng.randrange(10**6)}"] if how < 0.7 else [out[at], f"n{rng.randrange(10**6)}"]
    return out


def test_planted_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(60))
    texts, families = [], defaultdict(list)
    for family in range(120):
        base = [f"w{rng.randrange(20_000)}" for _ in range(rng.choice([80, 150, 400, 1500]))]
        members = [base] + [edited(rng, base, max(1, len(base) // rng.choice([50, 70, 120]))) for _ in range(rng.choice([1, 1, 2, 6]))]
        for words in members:
            # one in three texts holds the same passage
            families[family].append(len(texts))
            texts.append(" ".join(words) + (" " + shared if family % 3 == 0 else ""))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(4), "").collect()}
    sets = [shingles(t) for t in texts]
    near = [(a, b) for m in families.values() for n, a in enumerate(m) for b in m[n + 1 :] if similarity(sets[a], sets[b]) >= 0.8]
    assert len(near) > 100
    assert sum(a in kept and b in kept for a, b in near) <= 0.03 * len(near)
    # of every family something stays, and nothing goes without a near copy of it
    assert all(any(i in kept for i in m) for m in families.values())
    assert {i for i in range(len(texts)) if i not in kept} <= {i for pair in near for i in pair}


def test_recall_on_the_given_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents").select(*corpus_pipeline.COLUMNS)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    by_set = {}
    for r in docs.orderBy("doc_id").collect():
        by_set.setdefault(frozenset(shingles(r.text or "")), r.doc_id)
    listed, pairs = defaultdict(list), set()
    for s, i in by_set.items():
        for h in sorted(s, key=hash)[:40]:
            listed[h].append((i, s))
    for held in listed.values():
        if len(held) <= 300:
            pairs |= {(min(i, j), max(i, j)) for n, (i, a) in enumerate(held) for j, b in held[n + 1 :] if similarity(a, b) >= 0.8}
    assert len(pairs) > 30 and sum(a in kept and b in kept for a, b in pairs) <= 0.1 * len(pairs)


def test_equal_rows_leave_one(spark):
    row = ("a b c d e f g h", None, "s", 1)
    docs = spark.createDataFrame([(1, *row)] * 5 + [(None, *row)] * 2 + [(2, "other words stand here alone", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == {1: 1, 2: 1}


def test_passages_stand_wherever_their_text_does():
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3_000)]
    whole = set(simhash.text_profile(" ".join(words))[1])
    moved = set(simhash.text_profile(" ".join([f"x{i}" for i in range(500)] + words[700:2_500] + ["end"]))[1])
    assert len(whole & moved) >= 0.9 * len(set(simhash.text_profile(" ".join(words[700:2_500]))[1]))
    for text in (None, "", " \n", "one", "one two three four five"):
        fp, passages = simhash.text_profile(text)
        assert fp == simhash.text_fingerprint(text) and len(passages) == (1 if (text or "").split() else 0)
    long = " ".join(words * 20)
    assert simhash.text_profile(long)[0] == simhash.text_fingerprint(long)


def test_links_by_passages_are_verified(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b, c = a.replace("w100 ", "changed "), " ".join(f"w{i}" for i in range(0, 60)) + " " + " ".join(f"z{i}" for i in range(140))
    docs = spark.createDataFrame([(1, a), (2, b), (3, c)], "key long, text string")
    prints = {k: int.from_bytes(simhash.text_fingerprint(t), "big", signed=True) for k, t in ((1, a), (2, b), (3, c))}
    nodes = spark.createDataFrame([(prints[k], (False, k, k)) for k in prints], "fp long, least struct<unknown: boolean, doc_id: long, key: long>")
    links = spark.createDataFrame([(prints[1], prints[2]), (prints[1], prints[3])], "a long, b long")
    got = simhash.similar_links(docs, links, nodes, F.col("key")).collect()
    assert [(r.a, r.b) for r in got] == [(prints[1], prints[2])]
