"""Sources, timeline cases and streams on small literal inputs."""

import datetime as dt
import json

from pyspark.sql import functions as F

from timelinekit.functions import text as tx
from timelinekit.operators import feed as op
from timelinekit.operators import pauses as pz
from timelinekit.plans.layout import KeyLayout
from timelinekit.sources import feeds, markup, media
from timelinekit.streaming import jobs

LAYOUT = KeyLayout(("k",), "start_s")


def words(spark, *spans):
    rows = [("m", f"w{i + 1}", s, e) for i, (s, e) in enumerate(spans)]
    return spark.createDataFrame(rows, "k string, word_id string, start_s double, end_s double")


def test_gap_cuts_and_shift(spark):
    w = words(spark, (0.0, 0.4), (0.45, 0.9), (1.8, 2.2), (2.26, 2.7))
    cuts = pz.word_gap_cuts(w, LAYOUT, ["start_s"]).collect()
    assert [(c["after_id"], c["gap_s"]) for c in cuts] == [("w2", 0.9)]
    w = words(spark, (0.0, 0.4), (1.4, 1.8), (1.9, 2.3))
    cuts = pz.word_gap_cuts(w, LAYOUT, ["start_s"])
    assert cuts.first()["removed_s"] == 0.94
    moved = pz.shift_after_cuts(w, cuts, LAYOUT).orderBy("start_s").collect()
    assert [r["start_s"] for r in moved] == [0.0, 0.46, 0.96]


def test_split_cases(spark):
    cases = {
        "a": (0.0, 10.0, [(2.0, 3.0), (6.0, 6.5)], [(0.0, 2.0), (3.0, 6.0), (6.5, 10.0)]),
        "b": (4.0, 5.0, [(3.0, 6.0)], []),
        "c": (0.0, 5.0, [(0.2, 0.5)], [(0.5, 5.0)]),
        "d": (0.0, 0.9, [(0.3, 0.6)], [(0.0, 0.9)]),
    }
    entries = spark.createDataFrame([(k, "u0001", c[0], c[1], "keep") for k, c in cases.items()], "k string, id string, start_s double, end_s double, kind string")
    cuts = spark.createDataFrame([(k, s, e) for k, c in cases.items() for s, e in c[2]], "k string, start_s double, end_s double")
    out = pz.split_by_cuts(entries, cuts, ["k"], 4.0).collect()
    for k, case in cases.items():
        assert sorted((r["start_s"], r["end_s"]) for r in out if r["k"] == k) == case[3]
    assert sorted(r["id"] for r in out if r["k"] == "a") == ["u0001p1", "u0001p2", "u0001p3"]


def test_coverage_case(spark):
    cuts = spark.createDataFrame([("m", "x", 5.0, 6.0), ("m", "y", 1.0, 3.0)], "k string, id string, start_s double, end_s double")
    windows = spark.createDataFrame([("m", 1.5, 2.0), ("m", 2.0, 2.75)], "k string, start_s double, end_s double")
    got = {r["id"]: (r["share"], r["confirmed"]) for r in pz.interval_coverage(cuts, windows, LAYOUT, "id").collect()}
    assert got == {"x": (0.0, False), "y": (0.625, True)}


def test_coverage_of_overlapping_windows(spark):
    cuts = spark.createDataFrame([("m", "x", 0.0, 5.0), ("m", "z", 8.0, 9.0)], "k string, id string, start_s double, end_s double")
    windows = spark.createDataFrame([("m", 0.0, 6.0), ("m", 2.0, 8.0), ("m", 4.0, 4.0)], "k string, start_s double, end_s double")
    got = {r["id"]: (r["share"], r["confirmed"]) for r in pz.interval_coverage(cuts, windows, LAYOUT, "id").collect()}
    assert got == {"x": (1.6, True), "z": (0.0, False)}


def test_split_deals_words(spark):
    entries = spark.createDataFrame(
        [("m", "u1", 0.0, 6.0, "keep", ["w1", "w2", "w3", "w4", "w9"], "one two three four"), ("m", "u2", 7.0, 12.0, "keep", ["w5"], "five"),
         ("m", "u3", 13.0, 14.0, "keep", ["w6"], "six"), ("m", "u4", 15.0, 20.0, "keep", None, "seven")],
        "k string, id string, start_s double, end_s double, kind string, word_ids array<string>, text string")
    cuts = spark.createDataFrame([("m", 1.5, 3.9), ("m", 8.5, 10.0), ("m", 16.0, 17.0)], "k string, start_s double, end_s double")
    said = spark.createDataFrame(
        [("m", "w1", 0.1, 0.6, "one"), ("m", "w2", 0.7, 1.2, "two"), ("m", "w3", 4.1, 4.6, "three"), ("m", "w4", 4.7, 5.4, "four"),
         ("m", "w5", 7.1, 7.5, "five"), ("m", "w6", 13.1, 13.5, "six"), ("n", "w9", 0.1, 0.6, "other")],
        "k string, word_id string, start_s double, end_s double, text string")
    got = {r["id"]: (r["text"], r["word_ids"]) for r in pz.split_by_cuts(entries, cuts, ["k"], 4.0, words=said).collect()}
    assert got == {
        "u1p1": ("one two", ["w1", "w2"]), "u1p2": ("three four", ["w3", "w4"]), "u2p1": ("five", ["w5"]), "u2p2": ("five", ["w5"]),
        "u3": ("six", ["w6"]), "u4p1": ("seven", None), "u4p2": ("seven", None),
    }


def test_balance_case(spark):
    df = spark.createDataFrame([("d", i + 1, f) for i, f in enumerate([True, True, False, True, False])], "d string, i int, flag boolean")
    out = {r["i"]: (r["slot"], r["main"]) for r in op.balance(df, ["d"], "i", "flag", 3, 1).collect()}
    assert [i for i, (_, main) in sorted(out.items()) if main] == [1, 3, 5]
    assert [i for i, _ in sorted(out.items(), key=lambda x: x[1][0])] == [1, 3, 5, 2, 4]


def test_junk_and_topic(spark):
    df = spark.createDataFrame([("Компания подвела итоги квартала и планы", "http://a/"), ("Нейросеть помогла найти редкую рукопись", "http://a/promo/x"),
                                ("Учёные нашли редкую рукопись в архиве", "http://a/b")], "title string, url string")
    assert [r["url"] for r in op.junk_filter(df).collect()] == ["http://a/b"]
    flags = df.select(op.topic_flag(F.lit(None).cast("boolean"), F.col("title"), F.lit("ИИ"))).collect()
    assert all(r[0] for r in flags)


def test_score_batch_keeps_failures(spark):
    def scorer(part):
        if (part["x"] == 3).any():
            raise RuntimeError("no answer")
        return [{"n": 0, "s": 2}, {"n": 9, "s": 1}]

    df = spark.createDataFrame([(i,) for i in range(6)], "x int").coalesce(1)
    got = {r["x"]: r["s"] for r in op.score_batch(df, scorer, "s int", batch=2).collect()}
    assert got == {0: 2, 1: None, 2: None, 3: None, 4: 2, 5: None}


def test_text_rules(spark):
    df = spark.createDataFrame([("Straße İstanbul ΣΑΣ ﬁne Ёлка",)], "t string")
    folded = df.select(tx.casefold(F.col("t"))).first()[0]
    assert folded == "Straße İstanbul ΣΑΣ ﬁne Ёлка".casefold()
    assert df.select(tx.normalize_tokens(F.col("t"))).first()[0][-1] == "елка"
    dates = spark.createDataFrame([("Tue, 26 Aug 2025 10:15:00 GMT",), ("2025-08-26T10:15:00+03:00",), ("nonsense",)], "d string")
    got = [r[0] for r in dates.select(F.unix_seconds(tx.parse_published(F.col("d")))).collect()]
    base = int(dt.datetime(2025, 8, 26, 10, 15, tzinfo=dt.timezone.utc).timestamp())
    assert got == [base, base - 3 * 3600, None]


def test_registry_and_feed(spark, tmp_path):
    (tmp_path / "feeds.txt").write_text("# list\n\nnews|A|http://a\nsci|B|http://b|crm\n")
    got = [tuple(r) for r in feeds.read_registry(spark, str(tmp_path / "feeds.txt")).collect()]
    assert got == [("news", "A", "http://a", None), ("sci", "B", "http://b", "crm")]
    rss = """<rss xmlns:content="c"><channel><title>F</title><item><title>One &amp;amp; two</title><link>http://x/1</link>
      <description><![CDATA[<p>Hello <b>you</b></p>]]></description><pubDate>Tue, 26 Aug 2025 10:15:00 +0300</pubDate></item>
      <item><title>No link</title></item></channel></rss>"""
    atom = '<feed><entry><title>T</title><link href="http://y/2"/><summary>S</summary><updated>2025-08-26T10:15:00Z</updated></entry></feed>'
    raw = spark.createDataFrame([("n", "A", rss), ("n", "B", atom), ("n", "C", "<rss><item><title>x</title>")], "category string, feed string, body string")
    rows = {r["url"]: r for r in feeds.feed_items(raw).collect()}
    assert set(rows) == {"http://x/1", "http://y/2"}
    assert rows["http://x/1"]["title"] == "One & two" and rows["http://x/1"]["summary"] == "Hello you" and rows["http://x/1"]["published"] is not None


def test_write_daily(spark, tmp_path):
    path = str(tmp_path / "out")
    day = spark.createDataFrame([("2025-08-26", 1)], "date string, v int")
    feeds.write_daily(day, path)
    feeds.write_daily(day.withColumn("v", F.lit(2)), path)
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [1]
    feeds.write_daily(day.withColumn("v", F.lit(2)), path, force=True)
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [2]


def test_transcripts(spark):
    def payload(words):
        return json.dumps({"segments": [{"start": 0.0, "end": 2.0, "text": "a b", "words": words}]})

    good = [{"word": "a", "start": 0.5, "end": 0.5}, {"word": "b", "start": 1.0, "end": 2.5}]
    far = [{"word": "a", "start": 9.0, "end": 9.5}]
    df = spark.createDataFrame([("ok", payload(good)), ("bad", payload(far)), ("even", payload(None))], "k string, body string")
    utterances, spoken, rejects = media.explode_transcripts(df, "k", "body")
    got = {(r["k"], r["word_id"]): (r["start_s"], r["end_s"]) for r in spoken.collect()}
    assert got[("ok", "w000001")] == (0.5, 0.5001) and got[("ok", "w000002")] == (1.0, 2.0) and got[("even", "w000002")] == (1.0, 2.0)
    assert [tuple(r)[:2] for r in rejects.collect()] == [("bad", "invalid word timing")]
    assert utterances.count() == 2


def test_segment_words(spark):
    elements = [("text", "Hi", 0.0, 0.4, 0), ("punct", ",", None, None, 0), ("text", "you", 0.5, 0.9, 0), ("text", "late", 1.6, 2.0, 0), ("text", "other", 2.7, 3.0, 1)]
    elements += [("text", f"w{i}", 3.0 + i * 0.5, 3.4 + i * 0.5, 1) for i in range(40)]
    schema = "k string, elements array<struct<kind: string, value: string, start_s: double, end_s: double, monologue: int>>"
    out = media.segment_words(spark.createDataFrame([("m", elements)], schema), "k").orderBy("utterance").collect()
    # Model of the rule: gap of .6 inside a monologue, or end beyond 15 s from the start.
    groups, begun, last = [], None, None
    for kind, value, s, e, mono in elements:
        if kind == "punct":
            groups[-1][-1] += value
            continue
        gap = s - last[0] if last and last[1] == mono else 0.0
        if begun is None or gap >= 0.6 or e - begun > 15:
            groups.append([])
            begun = s
        groups[-1].append(value)
        last = (e, mono)
    assert [r["text"] for r in out] == [" ".join(g) for g in groups]


def test_series_files(spark, tmp_path):
    (tmp_path / "clip1.json").write_text(json.dumps([{"t": 0.0, "sat": 1.0}, {"t": 0.2, "face": {"cy_pct": 40.0}}]))
    rows = media.read_series(spark, str(tmp_path / "clip1.json")).orderBy("sample_no").collect()
    assert [(r["clip"], r["t"], r["face"] is not None) for r in rows] == [("clip1", 0.0, False), ("clip1", 0.2, True)]


def test_feed_documents_are_parsed_once(spark):
    item = "<item><title>A &amp;amp; B</title><link>https://a.example/1</link><description>d</description><pubDate>Mon, 01 Jan 2024 09:00:00 +0000</pubDate></item>"
    bodies = [f"<rss><channel>{item}{item}</channel></rss>", f"<rss><channel>{item}", "<rss><channel></channel></rss>", None]
    raw = spark.createDataFrame([("c", f"f{i}", b) for i, b in enumerate(bodies)], "category string, feed string, body string")
    out = feeds.feed_items(raw, F.expr("TIMESTAMP'2024-01-01 08:00:00Z'"))
    assert [(r["feed"], r["title"], r["summary"]) for r in out.collect()] == [("f0", "A & B", "d")] * 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_xml") + plan.lower().count("xmltostructs") == 1 and plan.count("(item|entry)") == 1


def test_inventory(spark, tmp_path):
    for name, content in (("01_cam.mp4", b"a"), ("03_cam.mp4", b"b"), ("03_camera.mp4", b"b"), ("04_mic.wav", b"c")):
        (tmp_path / name).write_bytes(content)
    files = media.file_inventory(spark, str(tmp_path))
    faults = {r["fault"] for r in media.inventory_faults(files).collect()}
    assert faults == {"duplicate content", "duplicate role", "number gap", "no video"}


def test_notes_and_markup(spark):
    notes = "- [fix blocking] segment=01 range=0:10-0:05 cut\n- [fix speech] segment=02 fine\n- [rule candidate] scope=project keep it\nhm"
    df = spark.createDataFrame([("n", notes)], "k string, body string")
    fixes, rules, rejects = markup.parse_notes(df, "k", "body")
    assert [r["description"] for r in fixes.collect()] == ["fine"] and rules.count() == 1
    assert {r["reason"] for r in rejects.collect()} == {"unknown line", "reversed range"}


def test_markup_rejects_stay_in_their_row(spark):
    script = (
        "stray\n[0:01 — 0:03] KEEP id=u1\n\nsaid\n\nalso stray\n[0:04] CUT id=u2\n[0:05] MOTION m1 (начало)\nbrief\n[0:06] MOTION m1 (конец)\n"
        "[0:07] MOTION m2 (конец)\n[0:08] MOTION m2 (конец)\n[0:09] MOTION m2 (начало) @u1"
    )
    df = spark.createDataFrame([(1, script), (2, "# only a comment"), (3, None)], "k int, body string")
    rejects = markup.parse_markup(df, "k", "body")[2]
    assert sorted((r["k"], r["line_no"], r["reason"]) for r in rejects.collect()) == [
        (1, 0, "text outside a block"), (1, 5, "text outside a block"), (1, 6, "empty block"), (1, 7, "overlay without anchor"),
        (1, 10, "end without start"), (1, 12, "empty block"),
    ]
    assert "Exchange" not in rejects._jdf.queryExecution().executedPlan().toString()


def test_markup_is_parsed_once(spark):
    script = "[0:01] MOTION m1 (начало) @u1\nbrief\n[0:06] MOTION m1 (конец)\n[0:08] MOTION m1 (конец)\n[0:01 — 0:03] KEEP id=u1\nsaid"
    again = "[0:02] MOTION m1 (начало) @u2\nother\n\n\n\n\n[0:09] MOTION m1 (конец)\n[0:03] BROLL b1 (начало) @u1\nopen"
    df = spark.createDataFrame([(1, script), (1, again), (2, again), (None, script), (3, "only text"), (4, None)], "k int, body string")
    entries, overlays, rejects = markup.parse_markup(df, "k", "body")
    got = sorted((str(r["k"]), r["overlay_id"], r["anchor"], r["type"], r["start_s"], r["brief"], str(r["end_s"])) for r in overlays.collect())
    assert got == [
        ("1", "b1", "u1", "library-broll", 3.0, "open", "None"), ("1", "m1", "u1", "motion", 1.0, "brief", "9.0"),
        ("1", "m1", "u2", "motion", 2.0, "other", "9.0"), ("2", "b1", "u1", "library-broll", 3.0, "open", "None"),
        ("2", "m1", "u2", "motion", 2.0, "other", "9.0"), ("None", "m1", "u1", "motion", 1.0, "brief", "None"),
    ]
    assert sorted((str(r["k"]), r["id"], r["text"]) for r in entries.collect()) == [("1", "u1", "said"), ("None", "u1", "said")]
    for out in (entries, overlays, rejects):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("КОНЕЦ СЕГМЕНТА") == 1


def read_back(query, spark, name):
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def stream_of(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_stream_candidates(spark, tmp_path):
    at = dt.datetime(2025, 8, 26, 10)
    source = stream_of(spark, tmp_path, [("Same title", at), ("same TITLE!", at), ("Other", at)], "title string, published timestamp")
    query = jobs.stream_candidates(source).writeStream.format("memory").queryName("cand").outputMode("append").start()
    assert read_back(query, spark, "cand").count() == 2


def test_stream_edits(spark, tmp_path):
    rows = [("d1", 1, "draft", ["1", "x"], {"2": "a" * 200, "z": "no"}, "n"), ("d1", 2, "draft", ["2"], {}, None), ("d1", 3, "submit", ["-4"], {}, "go")]
    source = stream_of(spark, tmp_path, rows, "desk_id string, at long, action string, cut_words array<string>, rewrites map<string,string>, note string")
    drafts, submits = str(tmp_path / "drafts"), str(tmp_path / "submits")
    jobs.stream_edits(source, drafts, submits, str(tmp_path / "ck")).awaitTermination()
    assert [r["cut_words"] for r in spark.read.parquet(drafts).collect()] == [[2]]
    assert [r["cut_words"] for r in spark.read.parquet(submits).collect()] == [[-4]]


def test_stream_ledger(spark, tmp_path):
    events = [("p", 1, "begin", "phase1", 0), ("p", 2, "begin", "phase2", None), ("p", 3, "fail", None, None), ("p", 4, "resume", None, None),
              ("p", 5, "gate", "gate1", 99), ("p", 6, "gate", "gate1", None), ("p", 7, "approve", "gate1", None)]
    source = stream_of(spark, tmp_path, events, "project string, seq int, kind string, name string, expected_revision int")
    query = jobs.stream_ledger(source).writeStream.format("memory").queryName("ledger").outputMode("append").start()
    rows = read_back(query, spark, "ledger").collect()
    assert [r["state"] for r in rows] == ["PHASE1_RUNNING", "PHASE1_RUNNING", "FAILED_RECOVERABLE", "PHASE1_RUNNING", "PHASE1_RUNNING", "GATE1_REVIEW", "PHASE2_PENDING"]
    assert rows[4]["error"] == "stale revision" and rows[3]["attempt"] == 2 and rows[-1]["revision"] == 5


def test_stream_silence_matches_batch(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    levels = [-60, -60, -10, -60, -60, -60, -10, -10, -60, -60, -60]
    rows = [("m", base + dt.timedelta(seconds=i * 0.05), round(i * 0.05, 2), float(v)) for i, v in enumerate(levels)]
    rows.append(("z", base + dt.timedelta(hours=2), 0.0, -10.0))
    source = stream_of(spark, tmp_path, rows, "k string, ts timestamp, t double, level double")
    query = jobs.stream_silence(source, -30.0, 0.05, 0.1).writeStream.format("memory").queryName("quiet").outputMode("append").start()
    got = {(r["start_s"], r["end_s"]) for r in read_back(query, spark, "quiet").collect() if r["k"] == "m"}
    batch = spark.createDataFrame(rows, "k string, ts timestamp, t double, level double")
    runs = pz.silence_runs(batch, KeyLayout(("k",), "t"), ["t"], F.col("level") < -30, 0.05, 0.1).filter("k = 'm'").collect()
    assert got == {(r["start_s"], r["end_s"]) for r in runs} == {(0.0, 0.1), (0.15, 0.3), (0.4, 0.55)}
