"""Pause, interval and timeline queries.

Events of a user form a series (a user may be hot, so these layouts are measured); lines and
words belong to one document, which is one row of its table and therefore fits a task.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from timelinekit.catalogue.editorial import TOKENS_SQL
from timelinekit.catalogue.standins import SERIES, SHOTS, UTTERANCES, WORDS, series, shots, utterances, words, table
from timelinekit.operators import pauses as pz
from timelinekit.operators import timeline as tl
from timelinekit.plans.layout import KeyLayout

QUERIES, SQL = {}, {}
HOUR = 3600.0
MONTH = 30 * 86400.0

PER_DOCUMENT = KeyLayout(("k",), "start_s")


def _q(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _spans_of(spark, sf, event_type: str, seconds: float):
    rows = series(spark, sf).filter(F.col("event_type") == event_type)
    return rows.select("k", "id", F.col("t").alias("start_s"), (F.col("t") + seconds).alias("end_s"), "value")


def _spans_sql(event_type: str, seconds: float) -> str:
    return f"(SELECT k, id, t AS start_s, t + {seconds}::DOUBLE AS end_s, value FROM {SERIES} s WHERE event_type = '{event_type}')"


def _windows(spark, sf):
    """Disjoint windows: from a view event to the user's next event."""
    from timelinekit.plans.ordered import ordered_scan

    rows = series(spark, sf)
    layout = KeyLayout.measure(rows, ["k"], "t")
    nxt = ordered_scan(rows, layout, ["t", "id"], nxt={"end_s": "t"})
    return nxt.filter("event_type = 'view' AND end_s IS NOT NULL AND end_s > t").select("k", "id", F.col("t").alias("start_s"), "end_s")


_WINDOWS = f"""(SELECT k, id, t AS start_s, end_s FROM (
  SELECT *, lead(t) OVER (PARTITION BY k ORDER BY t, id) AS end_s FROM {SERIES} s)
  WHERE event_type = 'view' AND end_s IS NOT NULL AND end_s > t)"""


def _series_layout(spark, sf, order="start_s"):
    rows = series(spark, sf)
    measured = KeyLayout.measure(rows, ["k"], "t")
    return KeyLayout(("k",), order, measured.hot)


@_q("utterance_pauses", f"""SELECT k, 'pause-' || id || '-' || next_id AS pause_id, id AS after_id, next_id AS before_id,
  end_s AS start_s, next_start AS end_s, round(next_start - end_s, 6) AS duration_s
FROM (SELECT *, lead(id) OVER w AS next_id, lead(start_s) OVER w AS next_start FROM {UTTERANCES} u
  WINDOW w AS (PARTITION BY k ORDER BY start_s, id)) WHERE round(next_start - end_s, 6) >= 0.8""")
def _(spark, sf):
    return pz.utterance_pauses(utterances(spark, sf), PER_DOCUMENT, ["start_s", "id"])


@_q("long_gaps", f"""SELECT k, id AS after_id, round_even(round(nt - t - 60, 6), 3) AS gap_s FROM (
  SELECT *, lead(t) OVER (PARTITION BY k ORDER BY t, id) AS nt FROM {SERIES} s) WHERE nt - (t + 60) > 86400""")
def _(spark, sf):
    rows = series(spark, sf).select("k", "id", F.col("t").alias("start_s"), (F.col("t") + 60).alias("end_s"))
    return pz.long_gaps(rows, _series_layout(spark, sf), ["start_s", "id"], 86400.0)


_CUTS = f"""(SELECT k, 'gap-' || word_id || '-' || nid AS cut_id, word_id AS after_id, nid AS before_id, round(ns - end_s, 6) AS gap_s,
  round(end_s + 0.03, 6) AS start_s, round(ns - 0.03, 6) AS end_s,
  round(round(ns - 0.03, 6) - round(end_s + 0.03, 6), 6) AS removed_s
FROM (SELECT *, lead(start_s) OVER w AS ns, lead(word_id) OVER w AS nid FROM {WORDS} x
  WINDOW w AS (PARTITION BY k ORDER BY start_s, word_id)) WHERE round(ns - end_s, 6) >= 0.15)"""


@_q("word_gap_cuts", f"SELECT * FROM {_CUTS} c")
def _(spark, sf):
    return pz.word_gap_cuts(words(spark, sf), PER_DOCUMENT, ["start_s", "word_id"])


@_q("cut_plan_summary", f"""SELECT k, cut_count, removed_s, duration_s, round(duration_s - removed_s, 6) AS duration_after_s,
  round(round(duration_s - gaps, 6) / duration_s, 4) AS speech_share_before,
  round(round(duration_s - gaps, 6) / round(duration_s - removed_s, 6), 4) AS speech_share_after
FROM (SELECT d.k, d.duration_s, count(c.k) AS cut_count, round(coalesce(sum(c.removed_s), 0), 6) AS removed_s,
    coalesce(sum(c.gap_s), 0) AS gaps
  FROM (SELECT k, max(end_s) AS duration_s FROM {WORDS} x GROUP BY k) d
  LEFT JOIN {_CUTS} c ON d.k = c.k AND c.end_s <= d.duration_s + 1e-6 GROUP BY d.k, d.duration_s)""")
def _(spark, sf):
    spoken = words(spark, sf)
    durations = spoken.groupBy("k").agg(F.max("end_s").alias("duration_s"))
    cuts = pz.word_gap_cuts(spoken, PER_DOCUMENT, ["start_s", "word_id"]).select("k", "end_s", "removed_s", "gap_s")
    return pz.cut_plan_summary(cuts, durations, PER_DOCUMENT)


_LEVEL_MEDIAN = f"""(SELECT k, list_sort(list(-value))[len(list(-value)) // 2 + 1] AS m FROM {SERIES} s GROUP BY k)"""


@_q("adaptive_threshold", f"SELECT k, round(greatest(-60.0, least(-20.0, m - 10.0)), 2)::DOUBLE AS threshold FROM {_LEVEL_MEDIAN} x")
def _(spark, sf):
    levels = series(spark, sf).select("k", (-F.col("value")).alias("level"))
    return pz.adaptive_threshold(levels, ["k"])


_RUNS = f"""(SELECT k, round(min(t), 6) AS start_s, round(max(coalesce(nt, t + 60)), 6) AS end_s FROM (
    SELECT *, sum(CASE WHEN pq IS NULL OR pq <> q THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, id) AS run
    FROM (SELECT *, value < 20 AS q, lag(value < 20) OVER w AS pq, lead(t) OVER w AS nt FROM {SERIES} s
      WINDOW w AS (PARTITION BY k ORDER BY t, id)))
  WHERE q GROUP BY k, run HAVING max(coalesce(nt, t + 60)) - min(t) >= 21600)"""


def _silences(spark, sf):
    layout = _series_layout(spark, sf, "t")
    return pz.silence_runs(series(spark, sf), layout, ["t", "id"], F.col("value") < 20, 60.0, 6 * HOUR)


@_q("silence_runs", f"SELECT * FROM {_RUNS} r")
def _(spark, sf):
    return _silences(spark, sf)


@_q("silence_cuts", f"""SELECT k, printf('silence-%04d', CAST(n AS BIGINT)) AS cut_id, round(end_s - start_s, 6) AS gap_s,
  round(start_s + 0.06, 6) AS start_s, round(end_s - 0.06, 6) AS end_s, round(end_s - 0.06 - (start_s + 0.06), 6) AS removed_s
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY start_s) AS n FROM {_RUNS} r)""")
def _(spark, sf):
    return pz.silence_cuts(_silences(spark, sf), _series_layout(spark, sf))


@_q("interval_coverage", f"""SELECT k, id, share, share >= 0.5 AS confirmed FROM (
  SELECT c.k, c.id, round(coalesce(sum(least(c.end_s, w.end_s) - greatest(c.start_s, w.start_s)) FILTER (w.k IS NOT NULL), 0) / (c.end_s - c.start_s), 4) AS share
  FROM (SELECT k, CAST(id AS VARCHAR) AS id, start_s, end_s FROM {_spans_sql("error", 7200.0)} e) c
  LEFT JOIN {_WINDOWS} w ON c.k = w.k AND c.start_s < w.end_s AND w.start_s < c.end_s
  GROUP BY c.k, c.id, c.start_s, c.end_s)""")
def _(spark, sf):
    cuts = _spans_of(spark, sf, "error", 7200.0)
    return pz.interval_coverage(cuts, _windows(spark, sf), _series_layout(spark, sf), "id")


@_q("interval_coverage_overlapping", f"""SELECT k, id, share, share >= 0.5 AS confirmed FROM (
  SELECT c.k, c.id, round(coalesce(sum(least(c.end_s, w.end_s) - greatest(c.start_s, w.start_s)) FILTER (w.k IS NOT NULL), 0) / (c.end_s - c.start_s), 4) AS share
  FROM (SELECT k, CAST(id AS VARCHAR) AS id, start_s, end_s FROM {_spans_sql("error", 7200.0)} e) c
  LEFT JOIN {_spans_sql("view", 36000.0)} w ON c.k = w.k AND c.start_s < w.end_s AND w.start_s < c.end_s
  GROUP BY c.k, c.id, c.start_s, c.end_s)""")
def _(spark, sf):
    cuts = _spans_of(spark, sf, "error", 7200.0)
    return pz.interval_coverage(cuts, _spans_of(spark, sf, "view", 36000.0), _series_layout(spark, sf), "id")


@_q("shift_after_cuts", f"""SELECT w.k, CAST(w.id AS VARCHAR) AS id, round(w.start_s - coalesce(sum(c.end_s - c.start_s), 0), 6) AS start_s,
  round(w.end_s - coalesce(sum(c.end_s - c.start_s), 0), 6) AS end_s
FROM {_spans_sql("click", 60.0)} w LEFT JOIN {_spans_sql("error", 1800.0)} c ON w.k = c.k AND c.end_s <= w.start_s + 1e-9
GROUP BY w.k, w.id, w.start_s, w.end_s""")
def _(spark, sf):
    cuts = _spans_of(spark, sf, "error", 1800.0).withColumn("removed_s", F.col("end_s") - F.col("start_s"))
    return pz.shift_after_cuts(_spans_of(spark, sf, "click", 60.0), cuts, _series_layout(spark, sf), "id")


_PIECE = """flatten(list_transform(acc, lambda p:
  CASE WHEN c[1].e <= p.s OR c[1].s >= p.e THEN [p]
       WHEN least(c[1].s, p.e) - p.s <= 1e-6 AND p.e - greatest(c[1].e, p.s) <= 1e-6 THEN list_filter([p], lambda z: false)
       WHEN least(c[1].s, p.e) - p.s < 1800 AND p.e - greatest(c[1].e, p.s) < 1800 THEN [p]
       ELSE (CASE WHEN least(c[1].s, p.e) - p.s >= 1800 THEN [{'s': p.s, 'e': least(c[1].s, p.e)}] ELSE list_filter([p], lambda z: false) END)
         || (CASE WHEN p.e - greatest(c[1].e, p.s) >= 1800 THEN [{'s': greatest(c[1].e, p.s), 'e': p.e}] ELSE list_filter([p], lambda z: false) END)
  END))"""


@_q("split_by_cuts", f"""WITH e AS (SELECT k, CAST(id AS VARCHAR) AS id, start_s, end_s, CASE WHEN value >= 5 THEN 'keep' ELSE 'cut' END AS kind
  FROM {_spans_sql("signup", 36000.0)} s),
c AS (SELECT e.k, e.id, list([{{'s': c.start_s, 'e': c.end_s}}] ORDER BY c.start_s, c.end_s) AS cuts
  FROM e JOIN {_spans_sql("error", 7200.0)} c ON e.k = c.k AND e.start_s < c.end_s AND c.start_s < e.end_s AND e.kind = 'keep'
  GROUP BY e.k, e.id),
p AS (SELECT e.*, CASE WHEN cuts IS NULL THEN [{{'s': start_s, 'e': end_s}}]
    ELSE list_reduce([[{{'s': start_s, 'e': end_s}}]] || cuts, lambda acc, c: {_PIECE}) END AS pieces
  FROM e LEFT JOIN c ON e.k = c.k AND e.id = c.id),
w AS (SELECT e.k, e.id, list({{'id': CAST(w.id AS VARCHAR), 'mid': (w.start_s + w.end_s) / 2}} ORDER BY w.start_s, w.id) AS ws
  FROM e JOIN {_spans_sql("click", 60.0)} w ON e.k = w.k AND (w.start_s + w.end_s) / 2 BETWEEN e.start_s - 0.05 AND e.end_s + 0.05
  GROUP BY e.k, e.id),
x AS (SELECT p.*, ws, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM p LEFT JOIN w ON p.k = w.k AND p.id = w.id),
y AS (SELECT *, CASE WHEN len(pieces) = 1 AND abs(piece.s - start_s) < 1e-6 AND abs(piece.e - end_s) < 1e-6 THEN ws
  ELSE list_filter(ws, lambda z: z.mid BETWEEN piece.s - 1e-6 AND piece.e + 1e-6) END AS own FROM x),
z AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE ws END AS mine FROM y)
SELECT k, id AS entry_id, CASE WHEN len(pieces) > 1 THEN id || 'p' || i ELSE id END AS id, round(piece.s, 6) AS start_s,
  round(piece.e, 6) AS end_s, kind, coalesce(array_to_string(list_transform(mine, lambda v: v.id), ','), '') AS word_ids,
  coalesce(array_to_string(list_transform(mine, lambda v: 'w' || v.id), ' '), '') AS text FROM z""")
def _(spark, sf):
    entries = _spans_of(spark, sf, "signup", 36000.0).select(
        "k", F.col("id").cast("string").alias("id"), "start_s", "end_s",
        F.when(F.col("value") >= 5, F.lit("keep")).otherwise(F.lit("cut")).alias("kind"),
    )
    clicks = _spans_of(spark, sf, "click", 60.0).withColumn("text", F.concat(F.lit("w"), F.col("id").cast("string")))
    said = (
        tl.assign_by_midpoint(clicks, entries, ["k"])
        .groupBy("k", F.col("entry_id").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("start_s", F.col("id").alias("w"), "text"))).alias("_said"))
        .select("k", "id", F.transform("_said", lambda w: w["w"].cast("string")).alias("word_ids"),
                F.array_join(F.transform("_said", lambda w: w["text"]), " ").alias("text"))
    )
    spoken = entries.join(said, ["k", "id"], "left")
    cuts = _spans_of(spark, sf, "error", 7200.0)
    out = pz.split_by_cuts(spoken, cuts, ["k"], minimum=1800.0, words=clicks.withColumnRenamed("id", "word_id"))
    return out.select(
        "k", "entry_id", "id", pz.r6(F.col("start_s")).alias("start_s"), pz.r6(F.col("end_s")).alias("end_s"), "kind",
        F.coalesce(F.array_join("word_ids", ","), F.lit("")).alias("word_ids"), F.coalesce("text", F.lit("")).alias("text"),
    )


@_q("free_gaps", f"""WITH w AS (SELECT k, start_s AS x, end_s AS reach, 0 AS kind FROM {_spans_sql("error", 14400.0)} e
  UNION ALL SELECT DISTINCT k, {MONTH}, NULL, 1 FROM {_spans_sql("error", 14400.0)} e2),
r AS (SELECT *, greatest(0, coalesce(max(reach) OVER (PARTITION BY k ORDER BY kind, x, reach ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM w),
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f, x) AS gap_no FROM r WHERE x > f + 0.45)
SELECT k, gap_no, least(greatest(0, (f + x) / 2), {MONTH}::DOUBLE - 0.05::DOUBLE) AS stamp_s FROM g WHERE gap_no <= 4""")
def _(spark, sf):
    windows = _spans_of(spark, sf, "error", 14400.0)
    durations = windows.select("k").distinct().withColumn("duration_s", F.lit(MONTH))
    return tl.free_gaps(windows, durations, _series_layout(spark, sf))


@_q("interval_subtract", f"""WITH w AS (SELECT k, min(start_s) AS s, max(end_s) AS e FROM (
    SELECT *, sum(CASE WHEN m IS NULL OR start_s > m THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_s, end_s, id) AS g FROM (
      SELECT *, max(end_s) OVER (PARTITION BY k ORDER BY start_s, end_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
      FROM {_spans_sql("error", 7200.0)} e)) GROUP BY k, g),
f AS (SELECT k, e AS s, coalesce(lead(s) OVER (PARTITION BY k ORDER BY s), 1e12) AS e FROM w
  UNION ALL SELECT k, -1e12, min(s) FROM w GROUP BY k
  UNION ALL SELECT DISTINCT k, -1e12, 1e12 FROM {_spans_sql("click", 3600.0)} c WHERE k NOT IN (SELECT k FROM w))
SELECT c.k, c.id, greatest(c.start_s, f.s) AS start_s, least(c.end_s, f.e) AS end_s
FROM {_spans_sql("click", 3600.0)} c JOIN f ON c.k = f.k AND c.start_s < f.e AND f.s < c.end_s
WHERE least(c.end_s, f.e) - greatest(c.start_s, f.s) >= 0.12""")
def _(spark, sf):
    spans = _spans_of(spark, sf, "click", 3600.0)
    return tl.interval_subtract(spans, _spans_of(spark, sf, "error", 7200.0), _series_layout(spark, sf), "id")


@_q("assign_by_midpoint", f"""SELECT w.k, w.id, e.id AS entry_id FROM {_spans_sql("click", 60.0)} w JOIN {_spans_sql("view", 36000.0)} e ON w.k = e.k
  AND (w.start_s + w.end_s) / 2 BETWEEN e.start_s - 0.05 AND e.end_s + 0.05""")
def _(spark, sf):
    spoken = _spans_of(spark, sf, "click", 60.0)
    return tl.assign_by_midpoint(spoken, _spans_of(spark, sf, "view", 36000.0), ["k"]).select("k", "id", "entry_id")


@_q("assign_by_majority", f"""SELECT w.k, w.id, e.id AS entry_id, greatest(0, w.start_s - e.start_s) AS local_start_s,
  least(e.end_s - e.start_s, greatest(greatest(0, w.start_s - e.start_s) + 0.04, w.end_s - e.start_s)) AS local_end_s
FROM {_spans_sql("error", 7200.0)} w JOIN {_WINDOWS} e ON w.k = e.k AND w.start_s < e.end_s AND e.start_s < w.end_s
WHERE least(w.end_s, e.end_s) - greatest(w.start_s, e.start_s) >= 0.5 * greatest(w.end_s - w.start_s, 1e-6)""")
def _(spark, sf):
    out = tl.assign_by_majority(_spans_of(spark, sf, "error", 7200.0), _windows(spark, sf), ["k"])
    return out.select("k", "id", "entry_id", "local_start_s", "local_end_s")


@_q("rebase_timeline", f"""SELECT k, id, duration_s, coalesce(sum(duration_s) OVER (PARTITION BY k ORDER BY pos, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_s,
  sum(duration_s) OVER (PARTITION BY k ORDER BY pos, id ROWS UNBOUNDED PRECEDING) AS new_end_s
FROM {SHOTS} s WHERE kind = 'keep'""")
def _(spark, sf):
    entries = shots(spark, sf)
    layout = KeyLayout.measure(entries, ["k"], "pos")
    return tl.rebase_timeline(entries, layout, ["pos", "id"]).select("k", "id", "duration_s", "offset_s", "new_end_s")


@_q("chapter_offsets", f"""SELECT k, id, row_number() OVER w AS chapter, sum(duration_s) OVER w - duration_s AS offset_s
FROM {SHOTS} s WINDOW w AS (PARTITION BY k ORDER BY pos, id ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    entries = shots(spark, sf)
    layout = KeyLayout.measure(entries, ["k"], "pos")
    return tl.chapter_offsets(entries, layout, ["pos", "id"]).select("k", "id", "chapter", "offset_s")


_ENTRIES = f"(SELECT *, CASE WHEN (k + pos) % 3 = 0 THEN 'cut' ELSE 'keep' END AS kind FROM {UTTERANCES} u)"

# Every fifth line lists no words; the others list those that may sound in them and a few more.
_LISTED_SQL = f"""(SELECT *, CASE WHEN pos % 5 <> 4 THEN list_transform(range(CAST(floor(start_s / 0.4::DOUBLE) AS BIGINT), CAST(floor(end_s / 0.4::DOUBLE) AS BIGINT) + 3),
    lambda i: printf('w%06d', i)) END AS ids FROM {_ENTRIES} e WHERE kind = 'keep')"""


@_q("rebase_words", f"""WITH e AS (SELECT *, end_s - start_s AS d, coalesce(sum(end_s - start_s) OVER (PARTITION BY k ORDER BY start_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_s
  FROM {_LISTED_SQL} l),
w AS (SELECT e.k, e.id, e.place, e.offset_s, w.word_id, greatest(0, w.start_s - e.start_s) AS a, least(e.d, greatest(greatest(0, w.start_s - e.start_s) + 0.04::DOUBLE, w.end_s - e.start_s)) AS z
  FROM (SELECT *, unnest(ids) AS word_id, generate_subscripts(ids, 1) AS place FROM e) e JOIN {WORDS} w ON w.k = e.k AND w.word_id = e.word_id
  WHERE w.start_s < e.end_s AND e.start_s < w.end_s AND least(w.end_s, e.end_s) - greatest(w.start_s, e.start_s) >= 0.5::DOUBLE * greatest(w.end_s - w.start_s, 1e-6)
    AND len({TOKENS_SQL.format('w.text')}) > 0),
s AS (SELECT k, id, offset_s, d, len({TOKENS_SQL.format('text')}) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.k = e.k AND w.id = e.id))
SELECT k, id, CAST(row_number() OVER (PARTITION BY k, id ORDER BY place) AS INTEGER) AS word_no, word_id AS source_word_id, round(offset_s + a, 6) AS start_s, round(offset_s + z, 6) AS end_s,
  'source-words' AS timing FROM w
UNION ALL SELECT k, id, CAST(i + 1 AS INTEGER), NULL, round(offset_s + i * (d / n), 6), round(offset_s + (i + 1) * (d / n), 6), 'even-slices' FROM (SELECT *, unnest(range(n)) AS i FROM s)""")
def _(spark, sf):
    entries = entries_of(spark, sf)
    first, last = (F.floor(F.col(c) / 0.4) for c in ("start_s", "end_s"))
    ids = F.transform(F.sequence(first, last + 2), lambda i: F.format_string("w%06d", i))
    listed = entries.withColumn("ids", F.when(F.col("pos") % 5 != 4, ids))
    out = tl.rebase_words(listed, words(spark, sf), KeyLayout.measure(entries, ["k"], "start_s"), ["start_s", "id"], "ids")
    return out.select("k", "id", "word_no", "source_word_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "timing")



def entries_of(spark, sf):
    return utterances(spark, sf).withColumn("kind", F.expr("CASE WHEN (k + pos) % 3 = 0 THEN 'cut' ELSE 'keep' END"))


@_q("merge_adjacent_keeps", f"""WITH g AS (SELECT *, sum(CASE WHEN pk = 'keep' AND kind = 'keep' AND start_s - pe >= 0 AND start_s - pe <= 1.5
    THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY start_s, id) AS run
  FROM (SELECT *, lag(kind) OVER w AS pk, lag(end_s) OVER w AS pe FROM {_ENTRIES} e WINDOW w AS (PARTITION BY k ORDER BY start_s, id)))
SELECT k, arg_min(id, start_s) || CASE WHEN count(*) > 1 AND NOT suffix(arg_min(id, start_s), 'x1') THEN 'x1' ELSE '' END AS id, arg_min(kind, start_s) AS kind,
  min(start_s) AS start_s, arg_max(end_s, start_s) AS end_s, count(*) AS parts, string_agg(text, ' ' ORDER BY start_s, id) AS text
FROM g GROUP BY k, run""")
def _(spark, sf):
    return tl.merge_adjacent_keeps(entries_of(spark, sf), PER_DOCUMENT, ["start_s", "id"])


@_q("flag_spans", f"""WITH r AS (SELECT *, sum(CASE WHEN pq IS NULL OR pq <> keep THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS part
  FROM (SELECT *, length(text) % 5 <> 0 AS keep, lag(length(text) % 5 <> 0) OVER (PARTITION BY k ORDER BY pos) AS pq FROM {WORDS} w))
SELECT k, CAST(part AS BIGINT) AS part, keep, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS words,
  count(*) OVER (PARTITION BY k) AS parts FROM r GROUP BY k, part, keep""")
def _(spark, sf):
    return tl.flag_spans(words(spark, sf), KeyLayout(("k",), "pos"), ["pos"], F.length("text") % 5 != 0)


# Entries of twenty words: all stay, all go, or some go, in turn; and one entry per document that no word belongs to.
_EDIT_WORDS = f"""(SELECT *, 'e' || (pos // 20) AS id, CASE WHEN pos % 11 > 0 THEN word_id END AS wid,
  CASE (pos // 20) % 3 WHEN 0 THEN TRUE WHEN 1 THEN length(text) % 5 <> 0 ELSE FALSE END AS keep FROM {WORDS} w)"""


@_q("edited_entries", f"""WITH r AS (SELECT *, sum(CASE WHEN pq IS NULL OR pq <> keep THEN 1 ELSE 0 END) OVER (PARTITION BY k, id ORDER BY pos) AS part
  FROM (SELECT *, lag(keep) OVER (PARTITION BY k, id ORDER BY pos) AS pq FROM {_EDIT_WORDS} w)),
p AS (SELECT k, id, part, bool_and(keep) AS keep, arg_min(start_s, pos) AS start_s, arg_max(end_s, pos) AS end_s, coalesce(string_agg(wid, ' ' ORDER BY pos), '') AS word_ids,
  string_agg(text, ' ' ORDER BY pos) AS text, max(part) OVER (PARTITION BY k, id) AS parts FROM r GROUP BY k, id, part)
SELECT k, id || 'x' || CAST(part AS BIGINT) AS id, CASE WHEN keep THEN 'keep' ELSE 'cut' END AS kind, start_s, end_s, word_ids, text, CASE WHEN NOT keep THEN 'edit' END AS reason FROM p WHERE parts > 1
UNION ALL SELECT p.k, p.id, CASE WHEN keep THEN 'keep' ELSE 'cut' END, e.s, e.e, e.w, e.x, CASE WHEN NOT keep THEN 'edit' END
  FROM p JOIN (SELECT k, id, min(start_s) AS s, max(end_s) + 0.5 AS e, min(word_id) AS w, max(text) AS x FROM {_EDIT_WORDS} w GROUP BY k, id) e ON p.k = e.k AND p.id = e.id WHERE parts = 1
UNION ALL SELECT doc_id, 'none', 'cut', 0, 1, '', lang, 'old' FROM documents""")
def _(spark, sf):
    rows = words(spark, sf).withColumn("id", F.expr("'e' || (pos div 20)")).withColumn("wid", F.expr("CASE WHEN pos % 11 > 0 THEN word_id END"))
    owned = rows.groupBy("k", "id").agg(
        F.lit("keep").alias("kind"), F.min("start_s").alias("start_s"), (F.max("end_s") + 0.5).alias("end_s"),
        F.array(F.min("word_id")).alias("word_ids"), F.max("text").alias("text"), F.lit("old").alias("reason"),
    )
    bare = table(spark, sf, "documents").select(
        F.col("doc_id").alias("k"), F.lit("none").alias("id"), F.lit("cut").alias("kind"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"),
        F.array().cast("array<string>").alias("word_ids"), F.col("lang").alias("text"), F.lit("old").alias("reason"),
    )
    keep = F.expr("CASE (pos div 20) % 3 WHEN 0 THEN TRUE WHEN 1 THEN length(text) % 5 <> 0 ELSE FALSE END")
    out = tl.edited_entries(owned.unionByName(bare), rows, KeyLayout(("k", "id"), "pos"), ["pos"], keep, "wid")
    return out.withColumn("word_ids", F.array_join("word_ids", " "))


@_q("sentences", f"""WITH s AS (SELECT *, coalesce(sum(CAST(regexp_matches(text, '[.!?…]+[\"»)]*$') AS INT)) OVER (PARTITION BY k ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS sentence FROM {WORDS} w)
SELECT k, CAST(sentence AS BIGINT) AS sentence, min(pos) AS from_word, max(pos) AS to_word, min(start_s) AS start_s FROM s GROUP BY k, sentence""")
def _(spark, sf):
    return tl.sentences(words(spark, sf), KeyLayout(("k",), "pos"), ["pos"], "pos")


@_q("caption_events", f"""WITH d AS (SELECT k, max(end_s) AS duration_s FROM {WORDS} w GROUP BY k),
n AS (SELECT w.k, w.pos, w.text, d.duration_s, greatest(0, w.start_s) AS s, least(d.duration_s, greatest(greatest(0, w.start_s) + 0.04, w.end_s)) AS e,
    (row_number() OVER (PARTITION BY w.k ORDER BY w.pos) - 1) // 6 AS event FROM {WORDS} w JOIN d ON w.k = d.k),
g AS (SELECT k, event, arg_min(s, pos) AS s, arg_max(e, pos) AS e, max(duration_s) AS duration_s, string_agg(text, ' ' ORDER BY pos) AS phrase FROM n GROUP BY k, event),
l AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY event) AS ns FROM g)
SELECT k, CAST(event AS BIGINT) AS event, round(s, 6) AS start_s, round(CASE WHEN ns IS NULL THEN least(duration_s, e + 0.18)
  ELSE least(e + 0.08, greatest(s + 0.12, ns - 0.04)) END, 6) AS end_s, phrase FROM l""")
def _(spark, sf):
    spoken = words(spark, sf)
    durations = spoken.groupBy("k").agg(F.max("end_s").alias("duration_s"))
    return tl.caption_events(spoken, durations, KeyLayout(("k",), "pos"), ["pos"])


@_q("overlays_on_timeline", f"""WITH b AS (SELECT k, id, start_s, end_s, end_s - start_s AS d, coalesce(sum(end_s - start_s) OVER (PARTITION BY k ORDER BY start_s, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM {_ENTRIES} e WHERE kind = 'keep'),
v AS (SELECT k, id || 'v' AS overlay_id, id AS anchor FROM {_ENTRIES} e WHERE pos % 4 = 0),
x AS (SELECT v.*, b.start_s AS s, least(b.start_s + 3.0, b.end_s) AS e, b.d, b.o, b.end_s AS ae, b.start_s AS a FROM v JOIN b ON v.k = b.k AND v.anchor = b.id)
SELECT k, overlay_id, anchor, round(o, 3) AS render_start_s, round(o + least(d, greatest(0.2, e - a)), 3) AS render_end_s FROM x""")
def _(spark, sf):
    entries = entries_of(spark, sf)
    overlays = entries.filter("pos % 4 = 0").select(
        "k", F.concat("id", F.lit("v")).alias("overlay_id"), F.col("id").alias("anchor"), F.lit(None).cast("double").alias("from_s")
    )
    return tl.overlays_on_timeline(entries, overlays, PER_DOCUMENT, ["start_s", "id"])


@_q("lead_in_silence", f"""SELECT k, entry_id, round(lead_s, 3) AS lead_in_s FROM (
  SELECT e.k, e.id AS entry_id, min(w.start_s) - min(e.start_s) AS lead_s FROM {_spans_sql("view", 36000.0)} e JOIN {_spans_sql("click", 60.0)} w
    ON w.k = e.k AND e.start_s - 1e-6 <= w.start_s AND w.start_s < e.end_s - 1e-6 GROUP BY e.k, e.id) WHERE lead_s > 3600""")
def _(spark, sf):
    return tl.lead_in_silence(
        _spans_of(spark, sf, "click", 60.0), _spans_of(spark, sf, "view", 36000.0), ["k"], HOUR
    )
