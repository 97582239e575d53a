"""Measurement, profile and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelinekit.catalogue.standins import SERIES, SHOTS, WORDS, series, shots, table, words
from timelinekit.operators import measure as ms
from timelinekit.operators import signal as sg
from timelinekit.plans.layout import KeyLayout
from timelinekit.plans.ordered import ordered_scan
from timelinekit.session import cut_lineage

QUERIES, SQL = {}, {}
HOUR = 3600.0
PER_DOCUMENT = KeyLayout(("k",), "start_s")


def _q(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _layout(rows, order="t"):
    return KeyLayout.measure(rows, ["k"], order)


@_q("percentile_profile", """SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n,
  round_even(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round_even(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
  round_even(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round_even(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
  round_even(quantile_cont(l_extendedprice, 0.9), 4) AS p90, max(l_extendedprice) AS max
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(spark, sf):
    return ms.percentile_profile(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", ms.SUMMARY_PROBS, 4
    )


_PER_SUPPLIER = """(SELECT l_suppkey AS clip, avg(l_quantity) AS shot_s, avg(l_discount) * 100 AS pause_pct,
  CASE WHEN l_suppkey % 5 <> 0 THEN max(l_extendedprice) / 1000 END AS peak FROM lineitem GROUP BY l_suppkey)"""


def _per_supplier(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("clip")).agg(
        F.avg("l_quantity").alias("shot_s"), (F.avg("l_discount") * 100).alias("pause_pct"),
        F.when(F.col("l_suppkey") % 5 != 0, F.max("l_extendedprice") / 1000).alias("peak"),
    )


_LONG = f"""(SELECT clip, 'shot_s' AS metric, shot_s AS x FROM {_PER_SUPPLIER} a UNION ALL
  SELECT clip, 'pause_pct', pause_pct FROM {_PER_SUPPLIER} b UNION ALL SELECT clip, 'peak', peak FROM {_PER_SUPPLIER} c)"""
_PROFILE = f"""(SELECT metric, round_even(quantile_cont(x, 0.5), 2) AS value, round_even(min(x), 2) AS lo, round_even(max(x), 2) AS hi,
  count(x) AS n_refs FROM {_LONG} l WHERE x IS NOT NULL GROUP BY metric)"""


def _profile(spark, sf):
    return ms.cross_clip_profile(_per_supplier(spark, sf), ["shot_s", "pause_pct", "peak"], "clip")


@_q("cross_clip_profile", f"SELECT * FROM {_PROFILE} p")
def _(spark, sf):
    return _profile(spark, sf)


@_q("corridor_check", f"""SELECT clip, m.metric, CASE WHEN x IS NULL OR value IS NULL THEN 'no data'
  WHEN x BETWEEN lo - greatest(abs(value) * 0.06, 0.02) AND hi + greatest(abs(value) * 0.06, 0.02) THEN 'inside' ELSE 'outside' END AS verdict
FROM (SELECT l_orderkey AS clip, 'shot_s' AS metric, avg(l_quantity) AS x FROM lineitem GROUP BY 1
  UNION ALL SELECT l_orderkey, 'peak', max(l_extendedprice) / 1000 FROM lineitem GROUP BY 1) m LEFT JOIN {_PROFILE} p ON m.metric = p.metric""")
def _(spark, sf):
    clips = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("clip")).agg(
        F.avg("l_quantity").alias("shot_s"), (F.max("l_extendedprice") / 1000).alias("peak")
    )
    measured = clips.unpivot("clip", ["shot_s", "peak"], "metric", "mine")
    return ms.corridor_check(measured, _profile(spark, sf)).select("clip", "metric", "verdict")


@_q("category_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return ms.category_counts(table(spark, sf, "events"), ["user_id"], "event_type")


@_q("speech_stats", f"""WITH g AS (SELECT k, round_even(start_s - lag(end_s) OVER (PARTITION BY k ORDER BY start_s, word_id), 3) AS gap,
    start_s, end_s FROM {WORDS} w),
s AS (SELECT k, count(*) AS words, sum(end_s - start_s) AS speech, max(end_s) AS d FROM g GROUP BY k),
p AS (SELECT k, quantile_cont(gap, 0.5) AS a, quantile_cont(gap, 0.9) AS b, quantile_cont(gap, 0.99) AS c,
    count_if(gap > 0.3) AS x, count_if(gap > 0.5) AS y FROM g WHERE gap >= 0 GROUP BY k)
SELECT s.k, words, round_even(words / d * 60, 3) AS words_per_min, round_even(a, 6) AS gap_p50, round_even(b, 6) AS gap_p90,
  round_even(c, 6) AS gap_p99, coalesce(x, 0) AS over_300ms, coalesce(y, 0) AS over_500ms, round_even(speech / d, 3) AS speech_share
FROM s LEFT JOIN p ON s.k = p.k""")
def _(spark, sf):
    return ms.speech_stats(words(spark, sf), PER_DOCUMENT, ["start_s", "word_id"], digits=6)


_THRESHOLD = f"(SELECT k, greatest(12.0, quantile_cont(value, 0.97)) AS threshold FROM {SERIES} s GROUP BY k)"


def _thinned_sql(rows: str, gap: float) -> str:
    """Per key the greedy fold over the sorted list of times."""
    return f"""(SELECT k, unnest(list_reduce(list([t] ORDER BY t, id), lambda acc, x:
      CASE WHEN round(x[1] * 1e6) - round(acc[-1] * 1e6) > {gap} * 1e6 THEN acc || x ELSE acc END)) AS t FROM {rows} r GROUP BY k)"""


_JUMPS = f"""(SELECT s.k, s.id, s.t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, id) AS n FROM {SERIES} s0) s
  JOIN {_THRESHOLD} h ON s.k = h.k WHERE value > threshold AND n > 1)"""
_CUTS = _thinned_sql(_JUMPS, 21600)


def _cuts(spark, sf, rows, layout):
    return ms.shot_cuts(rows, layout, ["t", "id"], "value", 6 * HOUR)


@_q("jump_threshold", f"SELECT k, round_even(threshold, 6) AS threshold FROM {_THRESHOLD} t")
def _(spark, sf):
    return ms.jump_threshold(series(spark, sf), ["k"], "value").withColumn("threshold", F.bround("threshold", 6))


@_q("shot_cuts", f"SELECT k, t FROM {_CUTS} c")
def _(spark, sf):
    rows = series(spark, sf)
    return _cuts(spark, sf, rows, _layout(rows)).select("k", "t")


_SHOT_LENGTHS = f"""(SELECT k, start_s, t AS end_s, round(t - start_s, 6) AS length_s FROM (
  SELECT k, t, lag(t) OVER (PARTITION BY k ORDER BY t) AS start_s FROM (
    SELECT k, t FROM {_CUTS} c UNION ALL SELECT k, max(t) FROM {SERIES} s GROUP BY k UNION ALL SELECT DISTINCT k, 0.0::DOUBLE FROM {SERIES} s2))
  WHERE start_s IS NOT NULL)"""


@_q("shot_lengths", f"SELECT * FROM {_SHOT_LENGTHS} s")
def _(spark, sf):
    rows = series(spark, sf)
    layout = _layout(rows)
    ends = rows.groupBy("k").agg(F.max("t").alias("end_s"))
    return ms.shot_lengths(_cuts(spark, sf, rows, layout), ends, layout, "t")


@_q("shot_zoom", f"""WITH s AS (SELECT s.*, 0.85 + (id % 31) / 100.0 AS scale, id % 25 AS inliers,
    sum(CASE WHEN c.t IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.k ORDER BY s.t, s.id) AS shot
  FROM {SERIES} s LEFT JOIN {_CUTS} c ON s.k = c.k AND s.t = c.t),
p AS (SELECT k, shot, min(t) AS f, max(t) AS l, product(CASE WHEN inliers >= 12 AND scale > 0.9 AND scale < 1.1 THEN scale ELSE 1.0 END) AS zoom FROM s GROUP BY k, shot),
r AS (SELECT *, CASE WHEN shot = 0 THEN 0.0 ELSE f END AS start_s, coalesce(lead(f) OVER (PARTITION BY k ORDER BY shot), l) AS end_s FROM p)
SELECT k, CAST(shot AS BIGINT) AS shot, start_s, end_s, round_even(zoom, 6) AS zoom, abs(zoom - 1) > 0.012 AS moving,
  CASE WHEN abs(zoom - 1) > 0.012 THEN round_even(abs(zoom - 1) * 100 / (end_s - start_s), 6) END AS speed_pct_s FROM r WHERE end_s - start_s > 0.4""")
def _(spark, sf):
    rows = series(spark, sf).withColumn("scale", F.lit(0.85) + (F.col("id") % 31) / 100).withColumn("inliers", F.col("id") % 25)
    layout = _layout(rows)
    return ms.shot_zoom(rows, _cuts(spark, sf, rows, layout), layout, ["t", "id"], "scale", "inliers")


@_q("scale_steps", f"""SELECT k, id, round(change_pct, 6) AS change_pct, kind FROM (
  SELECT *, CASE WHEN abs(change_pct) > 8 THEN 'step' WHEN abs(change_pct) > 0.8 THEN 'smooth' END AS kind FROM (
    SELECT *, (value - was) / was * 100 AS change_pct FROM (SELECT *, lag(value) OVER (PARTITION BY k ORDER BY t, id) AS was FROM {SERIES} s)))
WHERE kind IS NOT NULL""")
def _(spark, sf):
    rows = series(spark, sf)
    out = ms.scale_steps(rows, _layout(rows), ["t", "id"], "value")
    return out.select("k", "id", (F.round(F.col("change_pct") * 1e6) / 1e6).alias("change_pct"), "kind")


_CHANGES = f"(SELECT k, id, t FROM {SERIES} s WHERE (id % 100) / 100.0 < 0.35 AND id % 7 > 0)"


@_q("change_events", f"""SELECT k, t, round_even(lead(t) OVER (PARTITION BY k ORDER BY t) - t, 6) AS hold_s FROM {_thinned_sql(_CHANGES, 43200)} c""")
def _(spark, sf):
    rows = series(spark, sf).withColumn("iou", (F.col("id") % 100) / 100).withColumn("area", (F.col("id") % 7).cast("double"))
    return ms.change_events(rows, _layout(rows), ["t", "id"], "iou", "area", 12 * HOUR).select("k", "t", "hold_s")


@_q("stable_runs", f"""WITH v AS (SELECT k, id, t, CASE WHEN event_type <> 'error' THEN value END AS y FROM {SERIES} s),
f AS (SELECT *, sum(CASE WHEN abs(y - p) <= 15 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t, id) AS run
  FROM (SELECT *, lag(y) OVER (PARTITION BY k ORDER BY t, id) AS p FROM v))
SELECT k, min(t) AS start_s, max(t) AS end_s, count(*) AS samples, min(y) AS low, max(y) AS high FROM f WHERE y IS NOT NULL
GROUP BY k, run HAVING count(*) >= 2 AND max(t) - min(t) >= 3600""")
def _(spark, sf):
    rows = series(spark, sf).withColumn("y", F.when(F.col("event_type") != "error", F.col("value")))
    return ms.stable_runs(rows, _layout(rows), ["t", "id"], "y", 15.0, HOUR)


@_q("insert_profile", f"""WITH v AS (SELECT k, id, t, CASE WHEN event_type <> 'error' THEN value END AS y FROM {SERIES} s),
f AS (SELECT *, sum(CASE WHEN abs(y - p) <= 15 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t, id) AS run
  FROM (SELECT *, lag(y) OVER (PARTITION BY k ORDER BY t, id) AS p FROM v)),
r AS (SELECT k, max(t) - min(t) AS len, quantile_cont(y, 0.5) AS level FROM f WHERE y IS NOT NULL GROUP BY k, run HAVING count(*) >= 2 AND max(t) - min(t) >= 3600),
p AS (SELECT k, count(*) AS inserts, sum(len) AS covered, quantile_cont(len, 0.5) AS m, quantile_cont(level, 0.5) AS l FROM r GROUP BY k)
SELECT e.k, coalesce(inserts, 0) AS inserts, round_even(coalesce(covered, 0) / last, 4) AS share, round_even(m, 4) AS length_s, round_even(l, 4) AS level
FROM (SELECT k, max(t) AS last FROM {SERIES} s GROUP BY k) e LEFT JOIN p ON e.k = p.k""")
def _(spark, sf):
    rows = series(spark, sf).withColumn("y", F.when(F.col("event_type") != "error", F.col("value")))
    return ms.insert_profile(rows, _layout(rows), ["t", "id"], "y", 15.0, HOUR)


@_q("shot_summary", f"""SELECT k, count(*) AS shots, round_even(quantile_cont(length_s, 0.5), 4) AS median_s, round_even(avg(CAST(length_s < 90000 AS DOUBLE)), 4) AS short_share,
  round_even(max(end_s) / greatest(1, count(*) - 1), 4) AS cut_every_s FROM {_SHOT_LENGTHS} s GROUP BY k""")
def _(spark, sf):
    rows = series(spark, sf)
    layout = _layout(rows)
    ends = rows.groupBy("k").agg(F.max("t").alias("end_s"))
    return ms.shot_summary(ms.shot_lengths(_cuts(spark, sf, rows, layout), ends, layout, "t"), ["k"], 25 * HOUR)


@_q("step_summary", f"""WITH c AS (SELECT *, CASE WHEN abs(change_pct) > 8 THEN 'step' WHEN abs(change_pct) > 0.8 THEN 'smooth' END AS kind FROM (
    SELECT *, (value - was) / was * 100 AS change_pct FROM (SELECT *, lag(value) OVER (PARTITION BY k ORDER BY t, id) AS was FROM {SERIES} s))),
i AS (SELECT *, t - lag(t) OVER (PARTITION BY k, kind ORDER BY t, id) AS gap FROM c WHERE kind IS NOT NULL)
SELECT k, count(*) FILTER (kind = 'step') AS steps, count(*) FILTER (kind = 'step' AND change_pct > 0) AS ups, count(*) FILTER (kind = 'step' AND change_pct < 0) AS downs,
  count(*) FILTER (kind = 'smooth') AS smooth, round_even(quantile_cont(gap, 0.5) FILTER (kind = 'step'), 4) AS interval_s,
  round_even(quantile_cont(change_pct, 0.5) FILTER (kind = 'step' AND change_pct > 0), 4) AS up_pct, round_even(quantile_cont(change_pct, 0.5) FILTER (kind = 'step' AND change_pct < 0), 4) AS down_pct,
  round_even(quantile_cont(abs(change_pct), 0.5) FILTER (kind = 'step'), 4) AS size_pct, round_even(quantile_cont(abs(change_pct), 0.5) FILTER (kind = 'smooth'), 4) AS smooth_pct
FROM i GROUP BY k""")
def _(spark, sf):
    rows = series(spark, sf)
    layout = _layout(rows)
    return ms.step_summary(ms.scale_steps(rows, layout, ["t", "id"], "value"), layout, ["t", "id"])


@_q("row_clusters", """WITH h AS (SELECT source AS k, n_chars // 40 AS row_no, count(*) AS hits FROM documents GROUP BY ALL),
f AS (SELECT *, sum(CASE WHEN p IS NULL OR row_no - p > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY row_no) AS run
  FROM (SELECT *, lag(row_no) OVER (PARTITION BY k ORDER BY row_no) AS p FROM h WHERE hits >= 1))
SELECT k, min(row_no) AS first_row, max(row_no) AS last_row FROM f GROUP BY k, run HAVING max(row_no) - min(row_no) >= 8""")
def _(spark, sf):
    histogram = table(spark, sf, "documents").groupBy(F.col("source").alias("k"), F.floor(F.col("n_chars") / 40).alias("row_no")).agg(
        F.count(F.lit(1)).alias("hits")
    )
    return ms.row_clusters(histogram, KeyLayout.measure(histogram, ["k"], "row_no"), "row_no", F.col("hits") >= 1)


_NEAREST = f"""(SELECT e.k, CAST(e.id AS VARCHAR) AS id, e.t, min(abs(e.t - p.t)) AS distance_s FROM {SERIES} e JOIN {SERIES} p ON e.k = p.k
  WHERE e.event_type = 'error' AND p.event_type = 'purchase' GROUP BY e.k, e.id, e.t)"""


def _nearest(spark, sf):
    rows = series(spark, sf)
    marks, edges = rows.filter("event_type = 'error'"), rows.filter("event_type = 'purchase'")
    return ms.nearest_boundary(marks, edges, _layout(rows), "t", "id")


@_q("nearest_boundary", f"SELECT k, id, t, round(distance_s, 6) AS distance_s FROM {_NEAREST} n")
def _(spark, sf):
    return _nearest(spark, sf).withColumn("distance_s", F.bround("distance_s", 6))


@_q("boundary_shares", f"""SELECT k, count(*) AS marks, round_even(avg(CAST(distance_s <= 3600 AS INT)), 4) AS near_share,
  round_even(avg(CAST(distance_s <= 7200 AS INT)), 4) AS mid_share, round_even(quantile_cont(distance_s, 0.5), 3) AS median_s FROM {_NEAREST} n GROUP BY k""")
def _(spark, sf):
    return ms.boundary_shares(_nearest(spark, sf), ["k"], HOUR, 2 * HOUR)


_HOURLY = f"(SELECT k, CAST(floor(t / 3600) AS BIGINT) AS frame, round(sum(value), 4) AS area FROM {SERIES} s GROUP BY ALL)"


@_q("event_windows", f"""SELECT e.k, e.id, o AS offset_frames, e.f + o AS frame, coalesce(h.area, 0) AS area
FROM (SELECT k, id, CAST(floor(t / 3600) AS BIGINT) AS f FROM {SERIES} s WHERE event_type = 'signup') e CROSS JOIN range(-3, 22) r(o)
LEFT JOIN {_HOURLY} h ON e.k = h.k AND h.frame = e.f + o""")
def _(spark, sf):
    rows = series(spark, sf)
    hourly = rows.groupBy("k", F.floor(F.col("t") / 3600).alias("frame")).agg(F.round(F.sum("value"), 4).alias("area"))
    events = rows.filter("event_type = 'signup'").select("k", "id", F.floor(F.col("t") / 3600).alias("_f"))
    out = ms.event_windows(events, hourly, ["k"], F.col("_f"), "frame", "area")
    return out.select("k", "id", F.col("offset").cast("long").alias("offset_frames"), "frame", "area")


@_q("decision_stats", f"""SELECT k, count_if(kind = 'keep') AS keeps, count_if(kind <> 'keep') AS cuts,
  round(sum(CASE WHEN kind = 'keep' THEN duration_s ELSE 0 END), 6) AS keep_s, round(sum(CASE WHEN kind <> 'keep' THEN duration_s ELSE 0 END), 6) AS cut_s,
  CAST(sum(CASE WHEN kind = 'keep' THEN length(id) ELSE 0 END) AS BIGINT) AS kept_words FROM {SHOTS} s GROUP BY k""")
def _(spark, sf):
    return ms.decision_stats(shots(spark, sf).withColumn("words", F.length("id")), ["k"])


@_q("composition_gap", f"""SELECT k, id, top_pct - chin_pct AS gap_pct FROM (SELECT k, id, CASE WHEN event_type <> 'error' THEN value END AS cy,
    CASE WHEN event_type <> 'error' THEN value + 10 END AS chin_pct, CASE WHEN event_type <> 'view' THEN CAST(id % 100 AS DOUBLE) END AS top_pct FROM {SERIES} s)
WHERE cy < 55 AND top_pct > chin_pct""")
def _(spark, sf):
    face = F.when(F.col("event_type") != "error", F.struct(F.col("value").alias("cy"), (F.col("value") + 10).alias("chin_pct")))
    cap = F.when(F.col("event_type") != "view", F.struct((F.col("id") % 100).cast("double").alias("top_pct")))
    rows = series(spark, sf).withColumn("face", face).withColumn("cap", cap)
    out = ms.gap_below(rows, F.col("face.cy"), F.col("face.chin_pct"), F.col("cap.top_pct"))
    return out.select("k", "id", "gap_pct")


@_q("candidate_ranking", """SELECT l_suppkey AS candidate, round_even(avg(l_discount), 4) AS match, round_even(avg(l_tax), 3) AS width_error,
  count(*) AS pairs FROM lineitem GROUP BY l_suppkey""")
def _(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("candidate"), "l_discount", "l_tax")
    return ms.candidate_ranking(pairs, "candidate", "l_discount", "l_tax")


@_q("block_envelope", f"""SELECT k, CAST(i // 8 AS BIGINT) AS block, round_even(avg(abs(value)), 6) AS envelope FROM (
  SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY t, id) - 1 AS i FROM {SERIES} s) GROUP BY k, i // 8 HAVING count(*) = 8""")
def _(spark, sf):
    rows = series(spark, sf)
    indexed = ordered_scan(rows, _layout(rows), ["t", "id"], number="_n").withColumn("i", F.col("_n") - 1)
    return sg.block_envelope(indexed, ["k"], "i", "value", 8)


# Two hourly envelopes per group of users: views against clicks.
def _envelopes_sql(event_type: str) -> str:
    return f"""(SELECT k % 10 AS k, CAST(floor(t / 3600) AS BIGINT) AS i, round(sum(value), 2) AS v FROM {SERIES} s
      WHERE event_type = '{event_type}' GROUP BY ALL)"""


def _envelope(spark, sf, event_type: str):
    rows = series(spark, sf).filter(F.col("event_type") == event_type)
    return rows.groupBy((F.col("k") % 10).alias("k"), F.floor(F.col("t") / 3600).alias("i")).agg(F.round(F.sum("value"), 2).alias("v"))


# The first and the last third of a group's own span of hours.
_SPAN = f"(SELECT k, min(i) AS lo, max(i) AS hi, (max(i) - min(i) + 1) // 3 AS third FROM {_envelopes_sql('view')} v GROUP BY k)"
_PARTS = {"whole": "true", "early": "a.i < lo + third", "late": "a.i > hi - third"}


def _lags_sql(part: str = "whole") -> str:
    return f"""(SELECT k, lag, overlap, CASE WHEN r IS NULL OR isnan(r) THEN -1 ELSE r END AS correlation FROM (
      SELECT a.k, CAST(b.i - a.i AS INT) AS lag, corr(a.v, b.v) AS r, count(*) AS overlap FROM {_envelopes_sql("view")} a JOIN {_SPAN} p ON a.k = p.k
        JOIN {_envelopes_sql("click")} b ON a.k = b.k AND b.i - a.i BETWEEN -12 AND 12 WHERE {_PARTS[part]} GROUP BY a.k, b.i - a.i) WHERE overlap >= 5)"""


def _lags(spark, sf):
    return sg.lag_correlation(_envelope(spark, sf, "view"), _envelope(spark, sf, "click"), ["k"], "i", "v", 12, 5)


@_q("lag_correlation", f"SELECT k, lag, overlap, round_even(correlation, 6) AS correlation FROM {_lags_sql()} l")
def _(spark, sf):
    return _lags(spark, sf).withColumn("correlation", F.bround("correlation", 6))


def _best_sql(part: str = "whole") -> str:
    return f"""(SELECT k, lag / 1.0 AS offset_s, round_even(b, 6) AS correlation, round_even(b - coalesce(s, -1), 6) AS prominence FROM (
      SELECT x.k, y.lag, y.b, max(CASE WHEN abs(x.lag - y.lag) > 2 THEN x.correlation END) AS s FROM {_lags_sql(part)} x JOIN (
        SELECT k, arg_max(lag, (correlation, -lag)) AS lag, max(correlation) AS b FROM {_lags_sql(part)} z GROUP BY k) y ON x.k = y.k GROUP BY x.k, y.lag, y.b))"""


@_q("best_lag", f"SELECT * FROM {_best_sql()} b")
def _(spark, sf):
    return sg.best_lag(_lags(spark, sf), ["k"], 1, 2)


@_q("drift_verdict", f"""SELECT *, CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
  SELECT w.k, w.offset_s, w.correlation, CASE WHEN hours >= 40 THEN round_even(ppm, 3) ELSE 0.0 END AS drift_ppm,
    concat_ws('; ', CASE WHEN w.correlation < 0.55 THEN 'correlation below threshold' END,
      CASE WHEN hours >= 40 AND abs(ppm) > 1500 THEN 'drift exceeds threshold' END) AS reasons
  FROM (SELECT w.*, hi - lo + 1 AS hours, (l.offset_s - e.offset_s) / greatest((hi - lo + 1 - third)::DOUBLE, 1.0::DOUBLE) * 1e6::DOUBLE AS ppm
    FROM {_best_sql()} w JOIN {_SPAN} p ON w.k = p.k LEFT JOIN {_best_sql("early")} e ON w.k = e.k LEFT JOIN {_best_sql("late")} l ON w.k = l.k) w)""")
def _(spark, sf):
    views = _envelope(spark, sf, "view")
    span = views.groupBy("k").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).withColumn("third", F.floor((F.col("hi") - F.col("lo") + 1) / 3))
    parts = F.array_compact(F.array(
        F.lit("whole"), F.when(F.col("i") < F.col("lo") + F.col("third"), F.lit("early")), F.when(F.col("i") > F.col("hi") - F.col("third"), F.lit("late"))
    ))
    marked = views.join(span, "k").withColumn("parts", parts)
    scores = sg.lag_correlation(marked, _envelope(spark, sf, "click"), ["k"], "i", "v", 12, 5, "parts")
    best = cut_lineage(sg.best_lag(scores, ["k", "window"], 1, 2))
    whole, early, late = (best.filter(F.col("window") == part).drop("window") for part in _PARTS)
    hours = F.col("hi") - F.col("lo") + 1
    return sg.drift_verdict(whole.join(span, "k"), early, late, ["k"], hours, F.col("third"))


@_q("freeze_share", f"""WITH r AS (SELECT k, sum(value) AS f, max(value) AS longest FROM {SERIES} s WHERE event_type = 'error' GROUP BY k),
s AS (SELECT k, sum(value) AS f FROM {SERIES} s WHERE event_type = 'signup' GROUP BY k),
m AS (SELECT k, count(*) * 100.0 AS d, count(*) * 90.0 AS sd, max(t) / 86400 AS v, max(CASE WHEN event_type = 'click' THEN t END) / 86400 AS a FROM {SERIES} s GROUP BY k),
j AS (SELECT m.*, coalesce(r.f, 0) / d AS share, coalesce(s.f, 0) / sd AS src, coalesce(longest, 0) AS longest FROM m LEFT JOIN r ON m.k = r.k LEFT JOIN s ON m.k = s.k)
SELECT k, round_even(share, 4) AS freeze_share, round_even(src, 4) AS source_freeze_share, round_even(share - src, 4) AS added_freeze_share, d >= 20 AS judged,
  round_even(longest, 3) AS longest_freeze_s, round_even(v - a, 3) AS av_drift_s,
  CASE WHEN (d >= 20 AND share - src > 0.03) OR (v > 0 AND a > 0 AND abs(v - a) > 0.25) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM j""")
def _(spark, sf):
    rows = series(spark, sf)
    media = rows.groupBy("k").agg(
        (F.count(F.lit(1)) * 100.0).alias("duration_s"), (F.count(F.lit(1)) * 90.0).alias("source_duration_s"),
        (F.max("t") / 86400).alias("video_s"), (F.max(F.when(F.col("event_type") == "click", F.col("t"))) / 86400).alias("audio_s"),
    )
    runs = rows.filter("event_type = 'error'").select("k", F.col("value").alias("duration_s"))
    source = rows.filter("event_type = 'signup'").select("k", F.col("value").alias("duration_s"))
    return sg.freeze_share(runs, source, media, ["k"])
