"""Rules as a table, ordered digests, streams with timers, and the take chain against sequential models."""

import datetime as dt
import hashlib
import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from timelinekit.operators import contracts as ct
from timelinekit.operators import cross as cr
from timelinekit.operators import editorial as ed
from timelinekit.operators import lineage as ln
from timelinekit.plans.digests import tree_digest
from timelinekit.plans.layout import KeyLayout
from timelinekit.streaming import timers


# rules
def test_adding_a_row_adds_a_rule(spark):
    probes = spark.createDataFrame([(1, 1, 1, 1080, 720, 30.0, 10.0, -3.0, -20.0), (2, 2, 1, 1080, 720, 30.0, 700.0, None, -50.0)],
                                   "k int, video_streams int, audio_streams int, width int, height int, fps double, duration_s double, peak_db double, mean_db double")
    probes = probes.selectExpr("*", "1080 AS want_width", "720 AS want_height", "30.0D AS want_fps", "duration_s AS want_duration_s")
    builtin = {(r["k"], r["rule"]) for r in ct.technical_rules(probes, ["k"]).collect()}
    assert builtin == {(2, "expected exactly one video stream"), (2, "audio loudness metrics unavailable"), (2, "audio is effectively silent")}
    table = ct.rule_table(spark)
    assert {(r["k"], r["rule"]) for r in ct.technical_rules(probes, ["k"], table).collect()} == builtin
    more = table.filter("rule <> 'audio is effectively silent'").unionByName(
        spark.createDataFrame([("technical", 99, "too long", "duration_s > 600"), ("render", 99, "elsewhere", "no_such_column > 1")], ct.RULE_SCHEMA))
    got = {(r["k"], r["rule"]) for r in ct.technical_rules(probes, ["k"], more).collect()}
    assert got == builtin - {(2, "audio is effectively silent")} | {(2, "too long")}
    flat, details = spark.createDataFrame([(1, "a")], "k int, id string"), spark.createDataFrame([(1, "a", 0.0, 1.0, 1.0)], "k int, id string, start_s double, end_s double, duration_s double")
    rule = spark.createDataFrame([("candidates", 0, "any candidate", "_flat >= 1")], ct.RULE_SCHEMA)
    assert [r["rule"] for r in ct.candidates_contract(flat, details, ["k"], rule).collect()] == ["any candidate"]
    with pytest.raises(ValueError):
        ct.rules_of("many", spark.range(ct.MOST_RULES + 1).selectExpr("'many' AS contract", "int(id) AS position", "string(id) AS rule", "'true' AS violated_when"))


# digests
def sequential_tree(items, chunk):
    while True:
        lists = [items[i : i + chunk] for i in range(0, len(items), chunk)]
        digests = [hashlib.sha256(("[" + ",".join(x) + "]").encode()).hexdigest() for x in lists]
        if len(digests) == 1:
            return digests[0]
        items = [f'"{d}"' for d in digests]


@pytest.mark.parametrize("parts", [1, 7])
def test_digest_equals_the_sequential_tree(spark, parts):
    sizes = {"a": 1, "b": 4, "c": 5, "d": 16, "e": 17, "f": 70}
    rows = [(k, i, json.dumps({"n": i}, separators=(",", ":"))) for k, n in sizes.items() for i in range(n)]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, item string").repartition(parts)
    got = {r["k"]: (r["members"], r["digest"]) for r in tree_digest(df, ["k"], ["i"], F.col("item"), 4).collect()}
    assert got == {k: (n, sequential_tree([f'{{"n":{i}}}' for i in range(n)], 4)) for k, n in sizes.items()}


def test_digest_with_every_key_hot(spark, tiny_limit):
    rows = [("k", i) for i in range(300)]
    got = tree_digest(spark.createDataFrame(rows, "k string, i int").repartition(5), ["k"], ["i"], F.col("i").cast("string"), 16).first()
    assert got["digest"] == sequential_tree([str(i) for i in range(300)], 16)


def test_small_groups_and_inventories_have_the_plain_hash(spark):
    rows = [("g", "02", "u1"), ("g", "01", 'u"9é')]
    df = spark.createDataFrame(rows, "g string, segment_id string, utterance_id string")
    refs = [{"segment_id": s, "utterance_id": u} for _, s, u in sorted(rows)]
    plain = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert cr.member_ids(df, ["g"], ["utterance_id", "segment_id"], ["segment_id"], "cross-take-").first()["group_id"] == "cross-take-" + plain(refs)[:16]
    files = [{"path": p, "sha256": h, "size_bytes": n} for p, h, n in (("b/x", "1f", 5), ("a/y", "2e", 7))]
    found = ln.inventory_digest(spark.createDataFrame([("p", *f.values()) for f in files], "p string, path string, sha256 string, size_bytes long"), ["p"]).first()
    assert (found["files"], found["total_bytes"], found["digest"]) == (2, 12, plain(sorted(files, key=lambda f: f["path"])))


# streams with timers
AT = dt.datetime(2025, 8, 26, 10)


def replay(spark, tmp_path, batches, schema, build, name):
    """Each list of rows is a micro-batch of its own."""
    timers.state_store(spark)
    path = str(tmp_path / name)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        (tmp_path / f"{name}-{n}").touch()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_first_items_of_a_replay_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    items = [(f"i{n:03d}", f"Title {rng.randrange(25)}!", None if rng.random() < 0.2 else f"http://x/{rng.randrange(30)}", AT + dt.timedelta(minutes=n), n) for n in range(60)]
    batches = [items[:20], items[15:40], items[40:] + items[:5]]  # some are delivered twice
    schema = "item_id string, title string, url string, published timestamp, rank int"
    marks = replay(spark, tmp_path, batches, schema, timers.stream_first_items, "firsts")
    got = {(r["item_id"], r["first"]) for r in timers.all_first(marks).collect()}
    assert got == {(r["item_id"], r["first"]) for r in timers.first_items(spark.createDataFrame(items, schema)).collect()}
    assert 5 < sum(first for _, first in got) < 40


def test_late_items_leave_and_tokens_are_freed(spark, tmp_path):
    day = dt.timedelta(days=1)
    batches = [[("a", "Same", "u1", AT, 1)], [("b", "Other", "u2", AT + 3 * day, 2)], [("late", "Same", "u9", AT, 3)],
               [("c", "Third", "u3", AT + 6 * day, 4)], [("d", "Fourth", "u4", AT + 6 * day, 5), ("again", "Same", "u1", AT + 6 * day, 6)]]
    marks = replay(spark, tmp_path, batches, "item_id string, title string, url string, published timestamp, rank int", timers.stream_first_items, "freed")
    got = {r["item_id"]: r["first"] for r in timers.all_first(marks).collect()}
    assert "late" not in got and got["a"] and got["again"]


def test_quiet_jobs_raise_one_alarm_each_time(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    beat = lambda job, at: (job, AT + at * minute)
    batches = [[beat("a", 0), beat("b", 0), beat("a", 10)], [beat("b", 30), beat("a", 10)], [beat("b", 85)], [beat("c", 100)], [beat("a", 101), beat("c", 130)], [beat("z", 1_000)], [beat("z", 1_001)]]
    out = replay(spark, tmp_path, batches, "job_id string, heartbeat_at timestamp", timers.stream_quiet_jobs, "alarms")
    got = {(r["job_id"], int((r["last_beat"] - AT).total_seconds() // 60), r["beats"]) for r in out.collect()}
    assert got == {("a", 10, 3), ("a", 101, 1), ("b", 85, 3), ("c", 130, 2)}
    assert out.count() == 4


# the take chain
def sequential_chain(rows, threshold, pause, hook):
    words = lambda t: re.findall(r"[\w']+", t.lower())

    def like(a, b):
        a, b = words(a), words(b)
        return SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0

    out, covered = set(), set()

    def take(priority, members, cut, keep):
        covered.update(m["id"] for m in members)
        for m in members:
            out.add((priority, m["id"], "keep" if m["id"] == keep else "cut" if m["id"] in cut else "member"))

    groups = {}
    for r in rows:
        if r["g"]:
            groups.setdefault(r["g"], []).append(r)
    for members in groups.values():
        if len(members) > 1:
            take(1, members, {m["id"] for m in members[:-1]}, members[-1]["id"])
    owner = {r["id"]: r["id"] for r in rows}
    for n, a in enumerate(rows):
        for b in rows[n + 1 :]:
            if like(a["text"], b["text"]) >= threshold:
                old, new = owner[b["id"]], owner[a["id"]]
                owner = {k: new if v == old else v for k, v in owner.items()}
    clusters = {}
    for r in rows:
        clusters.setdefault(owner[r["id"]], []).append(r)
    for members in [c for c in clusters.values() if len(c) > 1]:
        if not all(m["id"] in covered for m in members):
            take(2, members, {m["id"] for m in members[:-1]}, members[-1]["id"])
    blocks = []
    for a, b in zip([None, *rows], rows):
        if a is None or round(b["start"] - a["end"], 6) >= pause:
            blocks.append([])
        blocks[-1].append(b)
    head = lambda block: " ".join(m["text"] for m in block[:3])
    for n, left in enumerate(blocks):
        for right in blocks[n + 1 :]:
            if like(head(left), head(right)) >= threshold and not any(m["id"] in covered for m in left):
                take(3, left + right, {m["id"] for m in left}, right[-1]["id"])
    hooked = {}
    for r in rows:
        found = re.search(hook, r["text"], re.I)
        if found and r["id"] not in covered:
            hooked.setdefault(found[0].lower(), []).append(r)
    for members in hooked.values():
        if len(members) > 1:
            take(4, members, {m["id"] for m in members[:-1]}, members[-1]["id"])
    return out


def test_take_chain_against_the_sequential_rule(spark):
    rng, data, want = random.Random(21), [], {}
    base = [[f"w{rng.randrange(9)}" for _ in range(rng.randint(3, 7))] for _ in range(6)]
    for k in range(12):
        at, rows = 0.0, []
        for n in range(rng.randint(6, 22)):
            text = list(rng.choice(base))
            if rng.random() < 0.5:
                text[rng.randrange(len(text))] = rng.choice(["x", "y", "now then"])
            if rng.random() < 0.3:
                text = [f"q{rng.randrange(99)}" for _ in range(4)] + (["now then"] if rng.random() < 0.6 else [])
            at += rng.choice([0.1, 0.2, 9.0])
            rows.append({"id": f"u{n:02d}", "start": at, "end": at + 1.0, "text": " ".join(text), "g": rng.choice([None] * 9 + ["g1", "g2"])})
            at += 1.0
        # blocks of one sentence that is cut differently, so that only whole heads are alike
        told = [f"b{i}" for i in range(12)]
        for n in range(k % 4):
            at, cuts = at + 20.0, sorted(rng.sample(range(1, 12), 2))
            for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 12])):
                rows.append({"id": f"v{n}{i}", "start": at, "end": at + 1.0, "text": " ".join(told[a:b]), "g": None})
                at += 1.0
        data += [(k, r["id"], r["start"], r["end"], r["text"], r["g"]) for r in rows]
        want |= {(k, *t): None for t in sequential_chain(rows, 0.8, 5.0, r"now then")}
    df = spark.createDataFrame(data, "k int, id string, start_s double, end_s double, text string, take_group string")
    takes = ed.take_chain(df.repartition(3), KeyLayout(("k",), "start_s"), ["start_s", "id"], "take_group", 0.8, 5.0, "(?iU)now then").collect()
    assert {(r["k"], r["priority"], r["id"], r["role"]) for r in takes} == set(want)
    assert {r["priority"] for r in takes} == {1, 2, 3, 4}
