"""Camera, framing, caption and brief queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelinekit.catalogue.standins import SERIES, SHOTS, UTTERANCES, series, shots, table, utterances
from timelinekit.functions import text as tx
from timelinekit.operators import camera as cm
from timelinekit.operators import framing as fr
from timelinekit.operators import timeline as tl
from timelinekit.plans.layout import KeyLayout

QUERIES, SQL = {}, {}


def _q(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _dice(seed: str, salt: str) -> str:
    return f"(CAST(('0x' || left(sha256({seed} || '|' || {salt}), 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0::DOUBLE)"


@_q("hash_uniform", f"SELECT k, id, round({_dice('CAST(k AS VARCHAR)', 'id')}, 9) AS u FROM {SHOTS} s")
def _(spark, sf):
    return shots(spark, sf).select("k", "id", F.round(tx.hash_uniform(F.col("k"), F.col("id")), 9).alias("u"))


_ROLLED = f"""(SELECT k, id, pos, duration_s, least(greatest(15 + ({_dice("'clip-' || k", "id || ':step'")} * 2 - 1) * 6, 9), 25) AS step,
  {_dice("'clip-' || k", "id || ':dir'")} < 0.35 AS closer, CASE WHEN {_dice("'clip-' || k", "id || ':move'")} < 0.7 AND duration_s > 0 THEN
    (CASE WHEN {_dice("'clip-' || k", "id || ':sign'")} < 0.8 THEN 1 ELSE -1 END) * least(12.0, duration_s * 2.5) ELSE 0.0 END AS zoom FROM {SHOTS} s)"""

_PLAN = f"""(SELECT k, CAST(i - 1 AS INT) AS shot_no, shots[i].id AS id, shots[i].duration_s AS duration_s, CASE WHEN i = 1 THEN 0.0 ELSE shots[i].step END AS step, scales[i] AS scale, shots[i].zoom AS zoom FROM (
  SELECT k, shots, unnest(range(1, len(shots) + 1)) AS i, list_reduce([[1.0::DOUBLE]] || list_transform(shots[2:], lambda x: [x.step, CASE WHEN x.closer THEN 1.0 ELSE 0.0 END]), lambda acc, x:
      acc || [greatest(1.0, least(1.25, CASE WHEN acc[-1] <= 1.0 OR x[2] = 1.0 THEN acc[-1] * (1 + x[1] / 100) ELSE acc[-1] / (1 + x[1] / 100) END))]) AS scales
  FROM (SELECT k, list({{'id': id, 'duration_s': duration_s, 'step': step, 'closer': closer, 'zoom': zoom}} ORDER BY pos, id) AS shots FROM {_ROLLED} r GROUP BY k)))"""


def _shot_plan(spark, sf):
    return cm.shot_plan(shots(spark, sf), ["k"], ["pos"], F.concat(F.lit("clip-"), F.col("k").cast("string")))


@_q("shot_plan", f"""SELECT k, shot_no, id, duration_s, round_even(step, 3) AS cut_step_pct, round_even(scale, 5) AS start_scale,
  round_even(greatest(1.0, scale * (1 + zoom / 100)), 5) AS end_scale, round_even(zoom, 3) AS zoom_pct, abs(zoom) > 1e-6 AS moves FROM {_PLAN} p""")
def _(spark, sf):
    return _shot_plan(spark, sf)


@_q("plan_summary", f"""WITH p AS (SELECT k, shot_no, round_even(step, 3) AS step, round_even(zoom, 3) AS zoom, abs(zoom) > 1e-6 AS moves FROM {_PLAN} p)
SELECT k, count(*) AS shots, round_even(count_if(moves) / count(*), 3) AS moving_share, coalesce(round_even(count_if(moves AND zoom > 0) / nullif(count_if(moves), 0), 3), 0) AS zoom_in_share,
  coalesce(round_even(list_sort(list(step) FILTER (shot_no > 0))[len(list(step) FILTER (shot_no > 0)) // 2 + 1], 3), 0) AS median_step_pct,
  coalesce(round_even(list_sort(list(abs(zoom)) FILTER (moves))[len(list(zoom) FILTER (moves)) // 2 + 1], 3), 0) AS median_zoom_pct FROM p GROUP BY k""")
def _(spark, sf):
    return cm.plan_summary(_shot_plan(spark, sf), ["k"])


@_q("cadence_sample", f"""SELECT k, t, choice FROM (SELECT k, unnest(kept) AS t, unnest(range(1, len(kept) + 1)) AS choice FROM (
  SELECT k, list_reduce(list([t] ORDER BY t, id), lambda acc, x: CASE WHEN round(x[1] * 1e6) - round(acc[-1] * 1e6) >= 172800 * 1e6 THEN acc || x ELSE acc END) AS kept
  FROM {SERIES} s WHERE event_type <> 'error' GROUP BY k)) WHERE choice <= 6""")
def _(spark, sf):
    rows = series(spark, sf).withColumn("kind", F.expr("CASE WHEN event_type = 'error' THEN 'cut' ELSE 'keep' END"))
    layout = KeyLayout.measure(rows, ["k"], "t")
    return cm.cadence_sample(rows, layout, ["t", "id"], 2 * 86400.0).select("k", "t", "choice")


_MEDIA = "(SELECT l_orderkey AS k, sum(l_quantity) / 4 AS duration_s FROM lineitem GROUP BY 1)"


def _media(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.sum("l_quantity") / 4).alias("duration_s"))


@_q("probe_times", f"""SELECT DISTINCT k, round(p, 6) AS probe_s FROM (SELECT k, 0.0 AS p FROM {_MEDIA} m UNION ALL SELECT k, greatest(0, duration_s - 0.2) FROM {_MEDIA} m UNION ALL
  SELECT k, duration_s / 2 FROM {_MEDIA} m UNION ALL SELECT k, i * 2.0 FROM {_MEDIA} m, range(1, 200) r(i) WHERE i * 2.0 < duration_s)""")
def _(spark, sf):
    return cm.probe_times(_media(spark, sf), ["k"]).withColumn("probe_s", F.round("probe_s", 6))


@_q("seeded_probes", f"""SELECT k, CAST(i AS INT) AS probe_no, round(least(greatest(0, 0.08 + {_dice('CAST(k AS VARCHAR)', 'CAST(i AS VARCHAR)')} * (greatest(0.08, duration_s - 0.08) - 0.08)), greatest(0, duration_s - 0.05)), 6) AS probe_s
FROM {_MEDIA} m, range(1, 4) r(i)""")
def _(spark, sf):
    return cm.seeded_probes(_media(spark, sf), ["k"], F.col("k"), 3)


@_q("window_probes", f"""SELECT k, id, label, round_even(least(greatest(0, p), 2592000 - 0.05), 6) AS probe_s FROM (SELECT k, id, 'start' AS label, t + 0.12 AS p FROM {SERIES} s WHERE value / 40 > 0 UNION ALL
  SELECT k, id, 'mid', (t + (t + value / 40)) / 2 FROM {SERIES} s WHERE t + value / 40 > t UNION ALL SELECT k, id, 'end', t + value / 40 - 0.12 FROM {SERIES} s WHERE t + value / 40 - t >= 0.6)""")
def _(spark, sf):
    rows = series(spark, sf).select("k", "id", F.col("t").alias("start_s"), (F.col("t") + F.col("value") / 40).alias("end_s"), F.lit(2592000.0).alias("duration_s"))
    return cm.window_probes(rows, ["k", "id"])


@_q("proportional_split", f"""SELECT k, pos, round_even(10 + 120.0 * b / tot, 6) AS part_start_s, round_even(CASE WHEN pos = last THEN 130.0 ELSE 10 + 120.0 * (b + w) / tot END, 6) AS part_end_s FROM (
  SELECT k, pos, greatest(length(text), 1) AS w, sum(greatest(length(text), 1)) OVER (PARTITION BY k) AS tot, max(pos) OVER (PARTITION BY k) AS last,
    coalesce(sum(greatest(length(text), 1)) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {UTTERANCES} u)""")
def _(spark, sf):
    parts = utterances(spark, sf).select("k", "pos", "text", F.lit(10.0).alias("start_s"), F.lit(130.0).alias("end_s"))
    return cm.proportional_split(parts, KeyLayout(("k",), "pos"), "pos").drop("text")


# Splits at the first blank of a line; some lose a character, name a bad suffix or none, or an entry that is not there.
_SPLITS = f"""(SELECT k, CASE WHEN pos % 17 = 16 THEN 'lost' || pos ELSE id END AS id, no AS part_no, CASE WHEN no = 1 AND b > 0 THEN left(text, b - 1) WHEN no = 1 THEN text
    WHEN k % 5 = 0 THEN left(substr(text, b + 1), length(text) - b - 1) ELSE substr(text, b + 1) END AS text, CASE WHEN k % 7 = 0 THEN 'bad-' || no WHEN k % 3 = 0 THEN '' ELSE substr('ab', no, 1) END AS suffix
  FROM (SELECT *, instr(text, ' ') AS b FROM {UTTERANCES} u), (VALUES (1), (2)) n(no) WHERE no = 1 OR b > 0)"""
_BLANKS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
_SPLIT_FAULTS = f"""(SELECT a.k, a.id, CASE WHEN u.id IS NULL THEN 'unknown entry' WHEN n < 2 THEN 'fewer than two parts' WHEN blank THEN 'empty part' WHEN bad THEN 'bad suffix'
    WHEN joined <> regexp_replace(u.text, '{_BLANKS}', '', 'g') THEN 'parts differ from the text' END AS fault
  FROM (SELECT k, id, count(*) AS n, bool_or(bare = '') AS blank, bool_or(k % 7 = 0) AS bad, string_agg(bare, '' ORDER BY part_no) AS joined
    FROM (SELECT *, regexp_replace(text, '{_BLANKS}', '', 'g') AS bare FROM {_SPLITS} s) GROUP BY k, id) a LEFT JOIN {UTTERANCES} u ON a.k = u.k AND a.id = u.id)"""


def _splits(spark, sf):
    lines = utterances(spark, sf).withColumn("b", F.instr("text", " "))
    parts = lines.withColumn("part_no", F.explode(F.when(F.col("b") > 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.expr("""CASE WHEN part_no = 1 AND b > 0 THEN left(text, b - 1) WHEN part_no = 1 THEN text
        WHEN k % 5 = 0 THEN substr(text, b + 1, length(text) - b - 1) ELSE substr(text, b + 1) END""")
    suffix = F.expr("CASE WHEN k % 7 = 0 THEN 'bad-' || part_no WHEN k % 3 = 0 THEN '' ELSE substr('ab', part_no, 1) END")
    return parts.select("k", F.expr("CASE WHEN pos % 17 = 16 THEN 'lost' || pos ELSE id END").alias("id"), "part_no", text.alias("text"), suffix.alias("suffix"))


@_q("split_faults", f"SELECT k, id, fault FROM {_SPLIT_FAULTS} f")
def _(spark, sf):
    return cm.split_faults(utterances(spark, sf), _splits(spark, sf), ["k"])


@_q("apply_splits", f"""WITH ok AS (SELECT k, id FROM {_SPLIT_FAULTS} f WHERE fault IS NULL),
p AS (SELECT s.k, s.id, part_no, suffix, u.start_s, u.end_s, regexp_replace(s.text, '^{_BLANKS}|{_BLANKS}$', '', 'g') AS text
  FROM {_SPLITS} s JOIN ok ON s.k = ok.k AND s.id = ok.id JOIN {UTTERANCES} u ON s.k = u.k AND s.id = u.id),
w AS (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY k, id) AS tot FROM p)
SELECT k, id || CASE WHEN suffix = '' THEN 'p' || part_no ELSE suffix END AS id, 'keep' AS kind, round_even(CASE part_no WHEN 1 THEN start_s ELSE start_s + (end_s - start_s) * (tot - n) / tot END, 6) AS start_s,
  round_even(CASE part_no WHEN 2 THEN end_s ELSE start_s + (end_s - start_s) * n / tot END, 6) AS end_s, CASE part_no WHEN 1 THEN id ELSE '' END AS word_ids, text FROM w
UNION ALL SELECT k, id, 'keep', start_s, end_s, id, text FROM {UTTERANCES} u WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.k = u.k AND ok.id = u.id)""")
def _(spark, sf):
    lines = utterances(spark, sf).withColumn("kind", F.lit("keep")).withColumn("word_ids", F.array("id")).withColumn("reason", F.lit(None).cast("string"))
    out = cm.apply_splits(lines, _splits(spark, sf), ["k"])
    return out.withColumn("word_ids", F.array_join("word_ids", " ")).drop("reason")


_ANCHORED = f"(SELECT k, id, start_s AS a, end_s AS b, CASE WHEN pos % 3 = 0 THEN start_s + 1.5 END AS s0 FROM {UTTERANCES} u)"


@_q("anchor_window", f"""SELECT k, id, s AS start_s, CASE WHEN e2 <= s THEN least(b, s + 1.8) ELSE e2 END AS end_s FROM (
  SELECT *, CASE WHEN e1 - s < 1.8 AND b - s >= 1.8 THEN least(s + 1.8, b) ELSE e1 END AS e2 FROM (
    SELECT *, least(s + 3.0, b) AS e1 FROM (SELECT *, coalesce(s0, CASE WHEN a + 0.5 >= b THEN a ELSE a + 0.5 END) AS s FROM {_ANCHORED} x)))""")
def _(spark, sf):
    rows = utterances(spark, sf).withColumn("s0", F.expr("CASE WHEN pos % 3 = 0 THEN start_s + 1.5D END"))
    start, end = tl.anchor_window(F.col("s0"), F.col("start_s"), F.col("end_s"), 0.5)
    return rows.select("k", "id", start.alias("start_s"), end.alias("end_s"))


# Detections: order lines as boxes in a 1080 x 1920 picture, supplier as clip.
_BOXES = """(SELECT l_suppkey AS k, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS box, l_partkey % 900 AS x, (l_orderkey * 7) % 1300 AS y, CAST(60 + l_quantity * 12 AS BIGINT) AS w,
  CAST(50 + l_linenumber * 70 + l_quantity * 4 AS BIGINT) AS h, 1080 AS src_w, 1920 AS src_h FROM lineitem)"""
_HEADS = f"""(SELECT * FROM {_BOXES} b WHERE h / src_h BETWEEN 0.10 AND 0.40 AND w / h BETWEEN 0.5 AND 1.6 AND y <= src_h * 0.55 AND x + w >= src_w * 0.15 AND x <= src_w * 0.85)"""


def _boxes(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS k", "l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS box", "l_partkey % 900 AS x", "(l_orderkey * 7) % 1300 AS y", "cast(60 + l_quantity * 12 AS bigint) AS w",
        "cast(50 + l_linenumber * 70 + l_quantity * 4 AS bigint) AS h", "1080 AS src_w", "1920 AS src_h",
    )


@_q("plausible_boxes", f"SELECT k, box, x, y, w, h FROM {_HEADS} h")
def _(spark, sf):
    return fr.plausible_boxes(_boxes(spark, sf)).select("k", "box", "x", "y", "w", "h")


_SCORE = "(1 - least(1, abs(h / greatest(src_h, 1) - 0.26) / 0.26)) * 0.7 + (1 - least(1, y / greatest(src_h * 0.5, 1))) * 0.3"


@_q("representative_box", f"""SELECT k, boxes, CASE WHEN boxes >= 5 THEN CAST(round_even(mx, 0) AS BIGINT) ELSE CAST(floor(b.x + b.w / 2) AS BIGINT) END AS cx, CASE WHEN boxes >= 5 THEN CAST(round_even(my, 0) AS BIGINT) ELSE b.y END AS top,
  CASE WHEN boxes >= 5 THEN CAST(round_even(mh, 0) AS BIGINT) ELSE b.h END AS height, bottom_max FROM (
  SELECT k, count(*) AS boxes, quantile_cont(x + w / 2, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(h, 0.5) AS mh, arg_max({{'x': x, 'y': y, 'w': w, 'h': h}}, ({_SCORE}, -box)) AS b, max(y + h) AS bottom_max FROM {_HEADS} h GROUP BY k)""")
def _(spark, sf):
    return fr.representative_box(fr.plausible_boxes(_boxes(spark, sf)), ["k"], "box")


_FRAMED = f"""(SELECT *, CAST(round_even(1080 * s, 0) AS BIGINT) + CAST(round_even(1080 * s, 0) AS BIGINT) % 2 AS scaled_w, CAST(round_even(1920 * s, 0) AS BIGINT) + CAST(round_even(1920 * s, 0) AS BIGINT) % 2 AS scaled_h FROM (
  SELECT *, least(greatest(1.0, 0.26 * 1280 / h, 720 / 1080.0, least(1280 * 0.9 / greatest(1, 1920 - crown), (720 / 1080.0) * 1.1)), 1e9) AS unused,
    least(greatest(cover, 0.26 * 1280 / h, least(1280 * (1 - 0.10) / greatest(1.0, 1920 - crown), cover * 1.10)), greatest(cover, CASE WHEN h / 1920.0 >= 0.18 THEN cover ELSE 0.34 * 1280 / h END)) AS s
  FROM (SELECT *, greatest(720 / 1080.0::DOUBLE, 1280 / 1920.0::DOUBLE) AS cover, greatest(0.0::DOUBLE, y - 0.18::DOUBLE * h) AS crown FROM {_HEADS} hh)))"""
_CROPPED = f"""(SELECT *, CAST(floor(cx) AS BIGINT) - CAST(floor(cx) AS BIGINT) % 2 AS crop_x, CAST(floor(cy) AS BIGINT) - CAST(floor(cy) AS BIGINT) % 2 AS crop_y FROM (
  SELECT *, least(greatest(0.0, (x + w / 2) * (scaled_w / 1080.0::DOUBLE) - 360), greatest(0.0, scaled_w - 720)) AS cx,
    least(greatest(0.0, crown * (scaled_h / 1920.0::DOUBLE) - 0.10::DOUBLE * 1280), greatest(0.0, scaled_h - 1280)) AS cy FROM {_FRAMED} f))"""


@_q("framing_plan", f"""SELECT k, box, scaled_w, scaled_h, crop_x, crop_y, round_even((y * (scaled_h / 1920.0::DOUBLE) - crop_y) / 1280, 4) AS headroom_ratio, round_even(h * (scaled_h / 1920.0::DOUBLE) / 1280, 4) AS height_ratio,
  CAST(round_even(x * (scaled_w / 1080.0::DOUBLE) - crop_x, 0) AS BIGINT) AS out_x, CAST(round_even(y * (scaled_h / 1920.0::DOUBLE) - crop_y, 0) AS BIGINT) AS out_y FROM {_CROPPED} c""")
def _(spark, sf):
    plan = fr.map_box(fr.framing_plan(fr.plausible_boxes(_boxes(spark, sf)), 720, 1280))
    return plan.select("k", "box", "scaled_w", "scaled_h", "crop_x", "crop_y", "headroom_ratio", "height_ratio", "out_x", "out_y")


@_q("caption_anchor", f"""SELECT k, box, cx, CASE WHEN y0 + 40 > 1920 THEN 1840 ELSE y0 END AS cy, span, y0 < y + h AND y0 + 60 > y AS overlaps FROM (
  SELECT *, CAST(540 AS BIGINT) AS cx, greatest(least(greatest(y + h + 192, 1152), 1267), y + h + 192) AS y0, least(greatest(280, CAST(floor(w * 2.2) AS BIGINT)), 928) AS span FROM {_HEADS} h)""")
def _(spark, sf):
    heads = fr.plausible_boxes(_boxes(spark, sf))
    x, y, span = fr.caption_anchor(F.col("y") + F.col("h"), F.col("w"), F.col("src_w"), F.col("src_h"))
    overlaps = fr.boxes_overlap(F.col("y"), F.col("y") + F.col("h"), y, y + 60)
    return heads.select("k", "box", x.cast("long").alias("cx"), y.alias("cy"), span.alias("span"), overlaps.alias("overlaps"))


@_q("composition_check", f"""SELECT k, box, concat_ws('; ', CASE WHEN y / 1920 < 0.04 THEN 'headroom too small' END, CASE WHEN y / 1920 > 0.40 THEN 'headroom extreme' END, CASE WHEN x < 24 THEN 'too close to the left edge' END,
  CASE WHEN y < 24 THEN 'too close to the top edge' END, CASE WHEN 1080 - (x + w) < 24 THEN 'too close to the right edge' END, CASE WHEN 1920 - (y + h) < 24 THEN 'too close to the bottom edge' END, CASE WHEN o > 0.20 THEN 'off centre' END) AS hard,
  concat_ws('; ', CASE WHEN y / 1920 > 0.18 AND y / 1920 <= 0.40 THEN 'headroom above the target band' END, CASE WHEN o > 0.14 AND o <= 0.20 THEN 'drifting off centre' END) AS soft
FROM (SELECT *, abs(x + w / 2 - 540) / 1080 AS o FROM {_HEADS} h)""")
def _(spark, sf):
    hard, soft = fr.composition_reasons(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("src_w"), F.col("src_h"))
    return fr.plausible_boxes(_boxes(spark, sf)).select("k", "box", F.array_join(hard, "; ").alias("hard"), F.array_join(soft, "; ").alias("soft"))


@_q("caption_sizes", """SELECT l_orderkey AS k, id, greatest(16, CAST(round_even(hgt * r, 0) AS BIGINT)) AS font_px, greatest(0.072, round_even(r * 1.25, 4)) AS hook_ratio,
  CASE WHEN wpx <= 0 THEN 28 ELSE greatest(8, least(28, CAST(floor(wpx / greatest(8.0, greatest(16, CAST(round_even(hgt * r, 0) AS BIGINT)) * 0.48::DOUBLE)) AS BIGINT))) END AS wrap_chars
FROM (SELECT l_orderkey, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 480 + (l_suppkey % 8) * 240 AS hgt, greatest(0.02, least(0.18, coalesce(CASE WHEN l_partkey % 4 <> 0 THEN l_discount * 2 END, 0.045))) AS r, CAST(l_quantity * 16 - 32 AS BIGINT) AS wpx FROM lineitem)""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS k", "concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS id", "480 + (l_suppkey % 8) * 240 AS hgt", "CASE WHEN l_partkey % 4 <> 0 THEN l_discount * 2 END AS r",
        "cast(l_quantity * 16 - 32 AS bigint) AS wpx",
    )
    return rows.select("k", "id", *[c.alias(n) for n, c in fr.caption_sizes(F.col("hgt"), F.col("r"), F.col("wpx")).items()])


# Briefs: part names and sizes put into the forms the rules look for.
_BRIEF = """(SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN p_name || ' «' || p_type || '» и "' || p_brand || '"' WHEN 1 THEN p_size || ' 000 → ' || p_size * 2 || ' ' || p_name WHEN 2 THEN 'индикатор ' || p_name
  WHEN 3 THEN p_size || ' месяцев, ' || p_name WHEN 4 THEN p_name || ' vs ' || p_type WHEN 5 THEN p_name || ' за ' || p_size || ' руб сразу' ELSE '(поверх речи, тихо) ' || p_name || '. Зачем: ' || p_type END AS brief FROM part)"""


def _briefs(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS k", """CASE p_partkey % 7 WHEN 0 THEN concat(p_name, ' «', p_type, '» и "', p_brand, '"') WHEN 1 THEN concat(p_size, ' 000 → ', p_size * 2, ' ', p_name)
      WHEN 2 THEN concat('индикатор ', p_name) WHEN 3 THEN concat(p_size, ' месяцев, ', p_name) WHEN 4 THEN concat(p_name, ' vs ', p_type) WHEN 5 THEN concat(p_name, ' за ', p_size, ' руб сразу')
      ELSE concat('(поверх речи, тихо) ', p_name, '. Зачем: ', p_type) END AS brief""")


@_q("classify_brief", """SELECT p_partkey AS k, ['text_punch', 'formula_split', 'meter_drop', 'stack_growth', 'scales_tilt', 'text_punch', 'kinetic_accent'][p_partkey % 7 + 1] AS class,
  CASE p_partkey % 7 WHEN 0 THEN p_type || ' / ' || p_brand WHEN 1 THEN p_size || ' 000 → ' || p_size * 2 WHEN 2 THEN '0 ₽' WHEN 3 THEN p_size || ' мес × 6 000' WHEN 4 THEN 'приоритеты' WHEN 5 THEN p_size || ' руб' ELSE '' END AS label FROM part""")
def _(spark, sf):
    kind, label = fr.classify_brief(F.col("brief"))
    return _briefs(spark, sf).select("k", kind.alias("class"), label.alias("label"))


@_q("screen_copy", """SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN p_name || ' «' || p_type || '» и "' || p_brand || '"' WHEN 1 THEN CASE WHEN len(string_split(p_name, ' ')) <= 2 THEN p_size || ' 000 → ' || p_size * 2 || ' ' || p_name ELSE '' END WHEN 2 THEN ''
  WHEN 3 THEN p_size || ' месяцев, ' || p_name WHEN 4 THEN p_name || ' vs ' || p_type WHEN 5 THEN p_name || ' за ' || p_size || ' руб сразу' ELSE p_name END AS shown FROM part""")
def _(spark, sf):
    return _briefs(spark, sf).select("k", tx.screen_copy(F.col("brief")).alias("shown"))


@_q("display_text", f"""SELECT k, id, md5(regexp_replace(replace(replace(lower(trim(regexp_replace(replace(text, 'Les ', 'Про женщины '), '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ё', 'е'), 'про женщины', 'PRO Женщин', 'g')) AS shown FROM {UTTERANCES} u""")
def _(spark, sf):
    spoken = F.replace(F.col("text"), F.lit("Les "), F.lit("Про женщины "))
    return utterances(spark, sf).select("k", "id", F.md5(tx.display_text(spoken)).alias("shown"))


@_q("phrase_chunks", f"""SELECT k, id, CAST(i AS INT) AS chunk_no, array_to_string(w[i * 6 + 1 : i * 6 + 6], ' ') AS chunk FROM (SELECT k, id, w, unnest(range(0, (len(w) + 5) // 6)) AS i FROM (
  SELECT k, id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM {UTTERANCES} u))""")
def _(spark, sf):
    return utterances(spark, sf).select("k", "id", F.posexplode(tx.phrase_chunks(F.col("text"), 6)).alias("chunk_no", "chunk"))


_WRAP = """list_reduce([['', '']] || list_transform(w, lambda x: [x]), lambda acc, x:
  CASE WHEN len(acc) > 2 + 2 THEN acc WHEN length(CASE WHEN acc[2] = '' THEN x[1] ELSE acc[2] || ' ' || x[1] END) <= 28 THEN acc[1:1] || [CASE WHEN acc[2] = '' THEN x[1] ELSE acc[2] || ' ' || x[1] END] || acc[3:]
    WHEN acc[2] = '' THEN acc[1:1] || [x[1]] || acc[3:]
    WHEN len(acc) = 2 THEN [''] || [x[1]] || [acc[2]] ELSE [''] || [x[1]] || acc[3:] || [acc[2]] || ['stop'] END)"""


@_q("wrap_lines", f"""SELECT k, id, CASE WHEN len(s) = 2 THEN s[2] WHEN len(s) = 3 THEN s[3] || CASE WHEN s[2] <> '' THEN '\\N' || s[2] ELSE '' END ELSE s[3] || '\\N' || s[4] || ' ' || s[2] END AS lines FROM (
  SELECT k, id, {_WRAP} AS s FROM (SELECT k, id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM {UTTERANCES} u))""")
def _(spark, sf):
    return utterances(spark, sf).select("k", "id", tx.wrap_lines(F.col("text"), 28, 2).alias("lines"))


@_q("timecodes", f"""SELECT k, id, CASE WHEN ms >= 3600000 THEN printf('%d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) ELSE printf('%d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) END AS code,
  ms / 1000.0 AS back, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS subtitle FROM (
  SELECT k, id, CAST(round_even(t / 100 * 1000, 0) AS BIGINT) AS ms, CAST(round_even(t / 100 * 100, 0) AS BIGINT) AS cs FROM {SERIES} s)""")
def _(spark, sf):
    t = F.col("t") / 100
    return series(spark, sf).select(
        "k", "id", tx.format_timecode(t).alias("code"), F.round(tx.parse_timecode(tx.format_timecode(t)), 3).alias("back"), tx.subtitle_time(t).alias("subtitle")
    )


@_q("fingerprint", """SELECT o_orderkey AS k, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), tx.fingerprint("o_orderkey", "o_orderstatus", "o_custkey").alias("fingerprint"))


@_q("repair_json", f"""SELECT k, id, CAST(pos AS BIGINT) AS n, CASE WHEN pos % 7 <> 3 THEN replace(replace(lang, 'e', ' '), chr(10), ' ') END AS s FROM {UTTERANCES} u""")
def _(spark, sf):
    # Replies: a fence, chatter before the body, raw line breaks in strings, or cut off.
    body = F.concat(F.lit('{"n": '), F.col("pos").cast("string"), F.lit(', "s": "'), F.regexp_replace("lang", "e", "\n"), F.lit('"}'))
    reply = (
        F.when(F.col("pos") % 7 == 3, F.concat(F.lit("so: "), F.left(body, F.lit(9))))
        .when(F.col("pos") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nbye")))
        .otherwise(F.concat(F.lit("Result "), body))
    )
    parsed = tx.repair_json(reply, "n bigint, s string")
    out = utterances(spark, sf).withColumn("_v", parsed)
    return out.select("k", "id", F.coalesce(F.col("_v.n"), F.col("pos").cast("bigint")).alias("n"), F.col("_v.s").alias("s"))
