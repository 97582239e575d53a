"""Camera plans and deterministic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.functions.text import hash_uniform
from timelinekit.operators.timeline import clamp_timestamp
from timelinekit.plans.layout import KeyLayout
from timelinekit.plans.ordered import ordered_scan
from timelinekit.plans.quantiles import upper_median
from timelinekit.plans.thinning import thin
from timelinekit.session import cut_lineage

# ---- fixed values -------------------------------------------------------------------------
ZOOM_SHARE, ZOOM_IN_SHARE = 0.70, 0.80
ZOOM_RATE_PCT_S, ZOOM_MAX_PCT = 2.5, 12.0
STEP_PCT, STEP_MIN_PCT, STEP_MAX_PCT = 15.0, 9.0, 25.0
CLOSER_SHARE = 0.35
CADENCE_S, MAX_PER_SEGMENT = 30.0, 6
PART_SUFFIX = "^[A-Za-z0-9]{1,8}$"
BLANKS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
# -------------------------------------------------------------------------------------------


def shot_plan(shots: DataFrame, keys: Sequence[str], order: Sequence[str], seed: Column) -> DataFrame:
    """Start scale, end scale and zoom of each shot.

    All dice are column expressions; only the scale depends on the shot before. That chain is
    a fold over the (step, direction) pairs of one clip.
    """
    spread = max(0.0, min(STEP_PCT - STEP_MIN_PCT, STEP_MAX_PCT - STEP_PCT))

    def dice(what: str) -> Column:
        return hash_uniform(seed, F.concat("id", F.lit(f":{what}")))

    step = F.least(F.greatest(F.lit(STEP_PCT) + (dice("step") * 2.0 - 1.0) * spread, F.lit(STEP_MIN_PCT)), F.lit(STEP_MAX_PCT))
    moves = dice("move") < ZOOM_SHARE
    magnitude = F.least(F.lit(ZOOM_MAX_PCT), F.col("duration_s") * ZOOM_RATE_PCT_S)
    signed = F.when(dice("sign") < ZOOM_IN_SHARE, magnitude).otherwise(-magnitude)
    rolled = shots.select(
        *keys, *order, "id", "duration_s", step.alias("_step"), (dice("dir") < CLOSER_SHARE).alias("_closer"),
        F.when(moves & (F.col("duration_s") > 0), signed).otherwise(F.lit(0.0)).alias("_zoom"),
    )
    fields = ["id", "duration_s", "_step", "_closer", "_zoom"]
    clip = rolled.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *fields))).alias("_shots")
    )

    def fold(state: Column, shot: Column) -> Column:
        before = state["scale"]
        factor = 1.0 + shot["_step"] / 100.0
        closer = (before <= 1.0) | shot["_closer"]
        wanted = F.when(closer, before * factor).otherwise(before / factor)
        clamped = F.greatest(F.lit(1.0), F.least(F.lit(1.0 + STEP_MAX_PCT / 100.0), wanted))
        first = F.size(state["scales"]) == 0
        scale = F.when(first, F.lit(1.0)).otherwise(clamped)
        return F.struct(scale.alias("scale"), F.array_append(state["scales"], scale).alias("scales"))

    start = F.struct(F.lit(1.0).alias("scale"), F.array().cast("array<double>").alias("scales"))
    scaled = clip.withColumn("_scales", F.aggregate("_shots", start, fold, lambda s: s["scales"]))
    rows = scaled.select(*keys, F.posexplode(F.arrays_zip("_shots", "_scales")).alias("shot_no", "_z"))
    shot, scale = F.col("_z._shots"), F.col("_z._scales")
    zoom = shot["_zoom"]
    end = F.greatest(F.lit(1.0), scale * (1.0 + zoom / 100.0))
    return rows.select(
        *keys, "shot_no", shot["id"].alias("id"), F.bround(shot["duration_s"], 6).alias("duration_s"),
        F.bround(F.when(F.col("shot_no") == 0, F.lit(0.0)).otherwise(shot["_step"]), 3).alias("cut_step_pct"),
        F.bround(scale, 5).alias("start_scale"), F.bround(end, 5).alias("end_scale"), F.bround(zoom, 3).alias("zoom_pct"),
        (F.abs(zoom) > 1e-6).alias("moves"),
    )


def plan_summary(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moving share, zoom-in share and upper medians of step and zoom."""
    keys = list(keys)
    # read three times below, so a plan's dice and folds are not run again for each
    plan = cut_lineage(plan.select(*keys, "shot_no", "cut_step_pct", "zoom_pct", "moves"))
    moving = F.col("moves")
    shares = plan.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shots"), F.count_if(moving).alias("_moving"), F.count_if(moving & (F.col("zoom_pct") > 0)).alias("_in")
    )
    steps = upper_median(plan.filter("shot_no > 0"), keys, "cut_step_pct", "_step").drop("n")
    zooms = upper_median(plan.filter("moves").withColumn("_z", F.abs("zoom_pct")), keys, "_z", "_zoom").drop("n")
    joined = shares.join(steps, keys, "left").join(zooms, keys, "left")
    return joined.select(
        *keys, "shots", F.bround(F.col("_moving") / F.col("shots"), 3).alias("moving_share"),
        F.coalesce(F.bround(F.try_divide("_in", "_moving"), 3), F.lit(0.0)).alias("zoom_in_share"),
        F.bround(F.coalesce("_step", F.lit(0.0)), 3).alias("median_step_pct"),
        F.bround(F.coalesce("_zoom", F.lit(0.0)), 3).alias("median_zoom_pct"),
    )


def cadence_sample(
    entries: DataFrame, layout: KeyLayout, order: Sequence[str], cadence: float = CADENCE_S, maximum: int = MAX_PER_SEGMENT
) -> DataFrame:
    """First KEEP entry, then each at least ``cadence`` after the last chosen one, at most ``maximum``."""
    chosen = thin(entries.filter("kind = 'keep'"), layout, order, cadence, at_least=True)
    return ordered_scan(chosen, layout, order, number="choice").filter(F.col("choice") <= maximum)


def probe_times(media: DataFrame, keys: Sequence[str], duration: str = "duration_s", interval: float = 2.0) -> DataFrame:
    """Start, end and middle plus a regular grid, each time once."""
    d = F.col(duration)
    grid = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(d / interval) - 1, F.lit(1)).cast("int")), lambda i: i * interval)
    grid = F.filter(grid, lambda x: x < d)
    marks = F.array(F.lit(0.0), F.greatest(F.lit(0.0), d - 0.2), d / 2)
    return media.select(*keys, F.explode(F.array_distinct(F.concat(marks, grid))).alias("probe_s"))


def seeded_probes(media: DataFrame, keys: Sequence[str], seed: Column, count: int, duration: str = "duration_s") -> DataFrame:
    """``count`` repeatable random times per item, away from both ends."""
    each = media.withColumn("probe_no", F.explode(F.sequence(F.lit(1), F.lit(count))))
    span = F.greatest(F.lit(0.08), F.col(duration) - 0.08) - 0.08
    at = F.lit(0.08) + hash_uniform(seed, F.col("probe_no")) * span
    return each.select(*keys, "probe_no", F.bround(clamp_timestamp(at, F.col(duration)), 6).alias("probe_s"))


def window_probes(windows: DataFrame, keys: Sequence[str], duration: str = "duration_s") -> DataFrame:
    """Near the start, in the middle, and near the end of windows of 0.6 s or more."""
    length = F.col("end_s") - F.col("start_s")
    stamps = F.array_compact(F.array(
        F.struct(F.lit("start").alias("label"), (F.col("start_s") + 0.12).alias("at")),
        F.struct(F.lit("mid").alias("label"), ((F.col("start_s") + F.col("end_s")) / 2).alias("at")),
        F.when(length >= 0.6, F.struct(F.lit("end").alias("label"), (F.col("end_s") - 0.12).alias("at"))),
    ))
    usable = windows.filter((length > 0) & (F.col("start_s") >= 0)).withColumn("_p", F.explode(stamps))
    return usable.select(*keys, F.col("_p.label").alias("label"), F.bround(clamp_timestamp(F.col("_p.at"), F.col(duration)), 6).alias("probe_s"))


def proportional_split(parts: DataFrame, layout: KeyLayout, order: str, text: str = "text") -> DataFrame:
    """Parts of a span share it by text length (at least one); the last part takes the end.

    ``parts`` carry key, ``order``, text and the span (start_s, end_s) of their whole.
    """
    keys = list(layout.keys)
    weighted = parts.withColumn("_w", F.greatest(F.length(text), F.lit(1)))
    totals = weighted.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    scanned = ordered_scan(layout.join_per_key(weighted, totals), layout, [order], before={"_before": "_w"}, nxt={"_after": F.lit(True)})
    span = F.col("end_s") - F.col("start_s")
    start = F.col("start_s") + span * F.col("_before") / F.col("_total")
    end = F.col("start_s") + span * (F.col("_before") + F.col("_w")) / F.col("_total")
    return scanned.select(
        *keys, order, text, F.bround(start, 6).alias("part_start_s"),
        F.bround(F.when(F.col("_after").isNull(), F.col("end_s")).otherwise(end), 6).alias("part_end_s"),
    )


def split_faults(entries: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First fault of every asked split: (keys, id, fault), null where the parts may be used.

    ``parts`` have id, part_no, text and suffix (null or empty: ``p`` and the number). Blanks aside, the parts
    put together must be the entry's text. Parts of an entry are put together, an entry is one row.
    """
    compact = lambda text: F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")
    suffix = part_suffix()
    asked = parts.groupBy(*keys, "id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(compact(F.col("text")) == "").alias("_blank"), F.bool_or(~suffix.rlike(PART_SUFFIX)).alias("_suffix"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_no", compact(F.col("text")).alias("t")))), lambda r: r["t"]), "").alias("_joined"),
    )
    known = entries.select(*keys, "id", compact(F.col("text")).alias("_text"), F.lit(True).alias("_known"))
    fault = (
        F.when(F.col("_known").isNull(), "unknown entry").when(F.col("_n") < 2, "fewer than two parts").when(F.col("_blank"), "empty part")
        .when(F.col("_suffix"), "bad suffix").when(F.col("_joined") != F.col("_text"), "parts differ from the text")
    )
    return asked.join(known, [*keys, "id"], "left").select(*keys, "id", fault.alias("fault"))


def part_suffix() -> Column:
    given = F.trim(F.coalesce("suffix", F.lit("")))
    return F.when(given == "", F.concat(F.lit("p"), F.col("part_no").cast("string"))).otherwise(given)


def apply_splits(entries: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries with the asked splits applied; an entry whose split has a fault stays whole (see ``split_faults``).

    Parts share the time by the length of their texts and are named by their suffix; word ids stay with the first.
    """
    ids = [*keys, "id"]
    usable = cut_lineage(split_faults(entries, parts, keys).filter("fault IS NULL").select(*ids))
    chosen = parts.join(usable, ids).withColumn("suffix", part_suffix()).withColumn("text", F.regexp_replace("text", f"^{BLANKS}|{BLANKS}$", ""))
    spans = chosen.join(entries.select(*ids, "start_s", "end_s"), ids)
    timed = proportional_split(spans, KeyLayout(tuple(ids), "part_no"), "part_no")
    named = timed.drop("text").join(chosen.select(*ids, "part_no", "suffix", "text"), [*ids, "part_no"])
    first = F.row_number().over(Window.partitionBy(*ids).orderBy("part_no")) == 1
    cut = named.withColumn("_first", first).join(entries.select(*ids, "kind", "word_ids", "reason"), ids).select(
        *keys, F.concat("id", "suffix").alias("id"), "kind", F.col("part_start_s").alias("start_s"), F.col("part_end_s").alias("end_s"),
        F.when(F.col("_first"), F.col("word_ids")).otherwise(F.array().cast("array<string>")).alias("word_ids"), "text", "reason",
    )
    rest = entries.join(usable, ids, "left_anti")
    return rest.select(*cut.columns).unionByName(cut)
