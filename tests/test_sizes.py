"""Findings of larger tables: plans that move less, and results that stay those of the SQL."""

import hashlib
import json
import math

from pyspark.sql import functions as F

from timelinekit.catalogue import ingest, standins
from timelinekit.functions.text import casefold, clean_html, display_text
from timelinekit.operators import camera as cm
from timelinekit.operators import cross as cr
from timelinekit.operators import decisions as dc
from timelinekit.operators import editorial as ed
from timelinekit.operators import lineage as ln
from timelinekit.operators import measure
from timelinekit.operators import search as se
from timelinekit.plans import similarity
from timelinekit.plans.layout import KeyLayout
from timelinekit.sources import media


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefixes_move_no_tokens(spark):
    texts = spark.createDataFrame([(1, "a", ["x", "y", "x"]), (1, "b", ["x", "y", "z"])], "k int, text_id string, tokens array<string>")
    for multiset in (True, False):
        assert "Exchange" not in _plan(similarity._prefixes(texts, ["k"], multiset, 0.8))


def test_pairs_are_whole_with_one_counter(spark, monkeypatch):
    said = [" ".join(f"w{(n * i) % 7}" for i in range(9)) + f" t{n % 4}" for n in range(40)]
    df = spark.createDataFrame([(1, f"u{i}", float(i), t) for i, t in enumerate(said)], "k int, id string, start_s double, text string")
    found = []
    for buckets in (similarity.ITEM_BUCKETS, 1):
        monkeypatch.setattr(similarity, "ITEM_BUCKETS", buckets)
        found.append({(r["a_id"], r["b_id"]) for r in ed.repeat_pairs(df, ["k"], "start_s", 0.7).collect()})
    assert found[0] == found[1] and found[0]


def _two_steps(items, chunk):
    lists = [hashlib.sha256(("[" + ",".join(items[i:i + chunk]) + "]").encode()).hexdigest() for i in range(0, len(items), chunk)]
    return lists[0] if len(lists) == 1 else hashlib.sha256(json.dumps(lists, separators=(",", ":")).encode()).hexdigest()


def test_digests_of_very_many_members_have_two_steps(spark):
    files = [("p", f"f{n:02d}", "1f", n) for n in range(23)]
    df = spark.createDataFrame(files, "p string, path string, sha256 string, size_bytes long").repartition(4)
    items = [json.dumps({"path": p, "sha256": h, "size_bytes": n}, separators=(",", ":")) for _, p, h, n in files]
    found = ln.inventory_digest(df, ["p"], 3).first()
    assert (found["files"], found["total_bytes"], found["digest"]) == (23, sum(range(23)), _two_steps(items, 3))
    ids = cr.member_ids(df, ["p"], ["path"], ["path"], "m-", 3).first()
    assert ids["group_id"] == "m-" + _two_steps([f'{{"path":"f{n:02d}"}}' for n in range(23)], 3)[:16]


def test_entities_without_their_end_stay(spark):
    df = spark.createDataFrame([("a&amp b&amp;c &quot;x&quot; &#65; &ampx; &amp;quot; &nosuch;",)], "h string")
    ended, all_ = df.select(clean_html(F.col("h"), ended=True), clean_html(F.col("h"))).first()
    assert ended == 'a&amp b&c "x" A &ampx; &quot; &nosuch;'
    assert all_ == 'a& b&c "x" A &x; &quot; &nosuch;'


def test_steps_from_zero(spark):
    rows = [(1, float(t), t, v) for t, v in enumerate((2.0, 0.0, 3.0, 0.0, 0.0, 0.0, -1.0))]
    df = spark.createDataFrame(rows, "k int, t double, id int, value double")
    steps = measure.scale_steps(df, KeyLayout(("k",), "t"), ["t", "id"], "value").orderBy("id").collect()
    got = [(r["id"], r["change_pct"], r["kind"]) for r in steps]
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6] and {g[2] for g in got} == {"step"}
    assert [got[i][1] for i in (0, 1, 2, 5)] == [-100.0, math.inf, -100.0, -math.inf] and math.isnan(got[3][1])


def test_documents_are_dealt_in_many_parts(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.range(40).selectExpr("id AS doc_id", "'one two\\nthree' AS text", "'en' AS lang", "'s' AS source").coalesce(1).write.parquet(path)
    least = standins.PARTS_PER_SPLIT * spark.read.parquet(path).rdd.getNumPartitions()
    for rows in (standins.words(spark, str(tmp_path)), standins.utterances(spark, str(tmp_path))):
        rows.collect()
        assert rows.rdd.getNumPartitions() >= least


def test_terms_nobody_asks_for_make_no_kinds(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(se, "cut_lineage", lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    assets = spark.range(400).selectExpr(
        "id AS asset_id", "array('blue', concat('n', id % 20)) AS tags", "concat('size', id DIV 20 % 20, IF(id % 2 = 0, ' blue', '')) AS description"
    )
    asked = spark.createDataFrame([("q", "blue")], "query_id string, query string")
    got = se.catalog_search(asked, assets, frequent=10).orderBy("place").collect()
    assert [(r["asset_id"], r["score"]) for r in got] == [(0, 4), (2, 4), (4, 4), (6, 4), (8, 4)]
    kinds = next(df for df in kept if df.columns == ["_kind", "_tags", "_texts", "asset_id"])
    assert kinds.count() == 2


def test_words_of_transcripts_come_from_one_pass(spark):
    said = "{segments: [{start: 0, end: 2, text: 'a b', words: [%s]}, {start: 2, end: 4, text: 'c d e'}]}"
    timed = "{word: 'a', start: 0, end: 1}, {word: 'b', start: %d, end: 2}"
    rows = [("ok", said % (timed % 1)), ("late", said % (timed % 9)), ("none", None)]
    raw = spark.createDataFrame([(k, b and b.replace("'", '"').replace("segments", '"segments"')) for k, b in rows], "k string, body string")
    body = F.regexp_replace("body", r"([{ ])([a-z]+):", '$1"$2":')
    utterances, words, rejects = media.explode_transcripts(raw.select("k", body.alias("body")), "k", "body")
    assert _plan(words).count("from_json") == 1 and "LeftAnti" not in _plan(words) + _plan(utterances)
    assert "Sort" in _plan(rejects) and not any("_words" in line for line in _plan(rejects).splitlines() if "Window" in line or "Sort" in line)
    assert [(r["k"], r["text"], r["start_s"]) for r in words.orderBy("word_id").collect()] == [
        ("ok", "a", 0.0), ("ok", "b", 1.0), ("ok", "c", 2.0), ("ok", "d", 2.666667), ("ok", "e", 3.333333)]
    assert {(r["k"], r["reason"]) for r in rejects.collect()} >= {("late", "invalid word timing")}
    assert {r["k"] for r in utterances.collect()} == {"ok"}


def test_lines_move_once_as_texts_before_they_are_segmented(spark, tmp_path):
    text = "One two, three.\n" + " ".join(f"w{i}" for i in range(30)) + "."
    spark.createDataFrame([(1, "en", "s", text)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ingest.QUERIES["segment_words"](spark, str(tmp_path))
    assert _plan(got).count("Exchange") == 2 and _plan(got).count("collect_list") == 4  # two aggregates, each partial and final
    rows = {(r["k"], r["utterance"]): (r["start_s"], r["end_s"], r["words"], r["text"]) for r in got.collect()}
    assert rows["1-u0001", 1] == (0.0, 1.1, 3, "One two, three.")
    assert [rows["1-u0002", n][2] for n in (1, 2, 3)] == [11, 11, 8] and rows["1-u0002", 3][3] == " ".join(f"w{i}" for i in range(22, 30)) + "."


def test_plan_summary_runs_the_plan_once(spark):
    shots = spark.range(60).selectExpr("id % 7 AS k", "concat('s', id) AS id", "id AS pos", "1.0D + id % 3 AS duration_s")
    plan = cm.shot_plan(shots, ["k"], ["pos"], F.col("k").cast("string"))
    assert "sha2" in _plan(plan)
    got = cm.plan_summary(plan, ["k"])
    assert "sha2" not in _plan(got) and got.agg(F.sum("shots")).first()[0] == 60


def test_words_are_not_moved_to_their_rewrites(spark):
    said = spark.createDataFrame([(1, f"w{i}", i, t, i * 1.0, i + 0.5) for i, t in enumerate("DE la Haus Maß".split())], "k int, word_id string, pos int, text string, start_s double, end_s double")
    said = said.repartition(3, "k")
    rewrites = said.filter("pos = 2").select("k", "word_id", F.lit("Neu Haus").alias("rewrite")).repartition(3, "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dc.overlay_corrections(said, rewrites, KeyLayout(("k",), "pos"), ["pos"], ("de", "la", "DE LA"))
        assert _plan(out).count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r["word_id"], r["caption"], r["end_s"]) for r in out.orderBy("start_s").collect()] == [("w0", "DE LA", 1.5), ("w2", "Neu Haus", 2.5), ("w3", "mass", 3.5)]


def test_folding_goes_through_its_tables_only_where_needed(spark):
    texts = ["Plain", "GROẞ Maß", "Ärger Ёж", "ſtark µ ς", "ﬁne ŉ ΐ", "ᲀода", "", None, "ПРО  Женщины и X10движение"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", casefold(F.col("t")).alias("folded"), display_text(F.col("t")).alias("shown")).collect()
    assert [r["folded"] for r in rows] == [None if t is None else t.casefold() for t in texts]
    assert rows[-1]["shown"] == "PRO Женщин и X10 Движение"
    assert _plan(df.select(casefold(F.col("t")).alias("f"))).count("lower(t#") == 1
