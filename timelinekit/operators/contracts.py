"""Contracts as rule tables: one row per violation, reasons as arrays of fixed texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelinekit.plans.layout import lookup_join

# ---- fixed values -------------------------------------------------------------------------
TIME_TOLERANCE_S = 1e-4
SIMILAR, RECOMMENDED = 0.84, 0.92
FPS_TOLERANCE, DURATION_TOLERANCE_S = 0.05, 0.35
PEAK_MAX_DB, MEAN_MIN_DB = -0.1, -40.0
CENTRE_DRIFT_MAX = 0.01
REPORT_COMPONENTS = {1: ("transcript", "technical"), 2: ("transcript", "technical", "visual", "motion")}
TEST_PROVIDERS = ("fixture", "sidecar")
RECIPE_FIELDS = ("id", "title", "what_happens", "tags", "situations", "anti_situations", "look", "compositor")
# -------------------------------------------------------------------------------------------


def violations(df: DataFrame, ids: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(ids, rule) for every rule that holds; a rule states the violation."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]))
    return df.select(*ids, F.explode(found).alias("rule"))


# Rules as rows: contract, rule, the condition that violates it. Conditions may use the columns the
# contract builds; rows of a contract apply in this order.
RULES = (
    ("candidates", "id listed twice", "_flat > 1"),
    ("candidates", "id detailed twice", "_detail > 1"),
    ("candidates", "listed without detail", "_detail IS NULL"),
    ("candidates", "detail not listed", "_flat IS NULL"),
    ("candidates", "range and duration differ", "_range"),
    ("candidates", "range is reversed", "_reversed"),
    ("groups", "member is not bound", "_ghosts > 0"),
    ("groups", "two members in one segment", "_in_segment > 1"),
    ("groups", "exactly one member must be kept", "_status = 'recommended' AND _kept <> 1"),
    ("groups", "kept member is not the last", "_status = 'recommended' AND _kept_at <> _last"),
    ("groups", "confidence outside its band",
     f"CASE WHEN _status = 'recommended' THEN _low < {RECOMMENDED}D ELSE _low < {SIMILAR}D OR _low >= {RECOMMENDED}D END"),
    ("groups", "uncertain group is actionable", "_status <> 'recommended' AND _actionable > 0"),
    ("render", "unknown style", "alignment IS NULL"),
    ("render", "caption size outside the style", "NOT caption_px BETWEEN min_font_px AND max_font_px"),
    ("render", "caption alignment", "caption_alignment <> alignment"),
    ("render", "caption colour", "upper(caption_color) <> upper(color)"),
    ("render", "caption font class", "caption_class <> font_class"),
    ("render", "caption centre drifts", f"abs(centre_drift) > {CENTRE_DRIFT_MAX}D"),
    ("render", "title is not larger than captions", "title_px <= caption_px"),
    ("render", "title is not below the face", "title_top < caption_top"),
    ("render", "overlay replaces the picture", "overlay_mode <> 'overlay'"),
    ("render", "director copy on screen", "copy_leaks > 0"),
    ("technical", "expected exactly one video stream", "video_streams <> 1"),
    ("technical", "expected exactly one audio stream", "audio_streams <> 1"),
    ("technical", "resolution mismatch", "width <> want_width OR height <> want_height"),
    ("technical", "frame rate mismatch", f"abs(fps - want_fps) > {FPS_TOLERANCE}D"),
    ("technical", "duration mismatch", f"abs(duration_s - want_duration_s) > {DURATION_TOLERANCE_S}D"),
    ("technical", "audio loudness metrics unavailable", "peak_db IS NULL OR mean_db IS NULL"),
    ("technical", "audio peak above the policy", f"peak_db > {PEAK_MAX_DB}D"),
    ("technical", "audio is effectively silent", f"mean_db < {MEAN_MIN_DB}D"),
)
RULE_SCHEMA = "contract string, position int, rule string, violated_when string"
MOST_RULES = 1_000


def rule_table(spark: SparkSession) -> DataFrame:
    """The built-in rules as a table (contract, position, rule, violated_when), to be stored and extended."""
    return spark.createDataFrame([(c, n, rule, when) for n, (c, rule, when) in enumerate(RULES)], RULE_SCHEMA)


def rules_of(contract: str, rules: DataFrame | None = None) -> list[tuple[str, Column]]:
    """A contract's rules in order, parsed once: from a table of rules, else the built-in ones.

    A table has at most ``MOST_RULES`` rows per contract, all of which the driver receives; a rule
    that does not parse, or names an unknown column, fails when the contract is applied.
    """
    if rules is None:
        return [(rule, F.expr(when)) for c, rule, when in RULES if c == contract]
    rows = rules.filter(F.col("contract") == contract).orderBy("position", "rule").select("rule", "violated_when").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules for {contract!r}")
    return [(r["rule"], F.expr(r["violated_when"])) for r in rows]


def candidates_contract(flat: DataFrame, details: DataFrame, keys: Sequence[str], rules: DataFrame | None = None) -> DataFrame:
    """Flat list and detail list of candidates must agree, ids be unique, ranges consistent.

    ``flat``: key, id; ``details``: key, id, start_s, end_s, duration_s.
    """
    keys = list(keys)
    by = [*keys, "id"]
    listed = flat.groupBy(*by).agg(F.count(F.lit(1)).alias("_flat"))
    full = details.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_detail"),
        F.bool_or(F.abs(F.col("end_s") - F.col("start_s") - F.col("duration_s")) > TIME_TOLERANCE_S).alias("_range"),
        F.bool_or(F.col("end_s") < F.col("start_s")).alias("_reversed"),
    )
    both = listed.join(full, by, "full_outer")
    return violations(both, by, rules_of("candidates", rules))


def groups_contract(members: DataFrame, bindings: DataFrame, by: Sequence[str], order: str, rules: DataFrame | None = None) -> DataFrame:
    """Groups of takes: known members, one per segment, the last kept, confidence in its band.

    ``members``: group key, segment, id, order, kept (null when uncertain), confidence, status;
    ``bindings``: segment, id.
    """
    by = list(by)
    known = bindings.groupBy("segment", "id").agg(F.count(F.lit(1)).alias("_bound"))
    joined = lookup_join(members, known, ["segment", "id"], "left")
    # Distinct segments without a set per group: count per (group, segment), then sum.
    per_segment = joined.groupBy(*by, "segment").agg(
        F.count(F.lit(1)).alias("_in_segment"), F.count_if(F.col("_bound").isNull()).alias("_ghosts"),
        F.count_if(F.col("kept")).alias("_kept"), F.max(F.when(F.col("kept"), F.col(order))).alias("_kept_at"),
        F.max(order).alias("_last"), F.min("confidence").alias("_low"), F.max("status").alias("_status"),
        F.count_if(F.col("kept").isNotNull()).alias("_actionable"),
    )
    groups = per_segment.groupBy(*by).agg(
        F.max("_in_segment").alias("_in_segment"), F.sum("_ghosts").alias("_ghosts"), F.sum("_kept").alias("_kept"),
        F.max("_kept_at").alias("_kept_at"), F.max("_last").alias("_last"), F.min("_low").alias("_low"),
        F.max("_status").alias("_status"), F.sum("_actionable").alias("_actionable"),
    )
    return violations(groups, by, rules_of("groups", rules))


def report_contract(reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reports must pass, hold the components of their schema version, and come from a real
    provider. ``reports``: key, schema_version, verdict, provider, components map<string,string>."""
    required = F.create_map(*[F.lit(x) for v, names in REPORT_COMPONENTS.items() for x in (v, ",".join(names))])
    wanted = F.split(F.try_element_at(required, F.col("schema_version")), ",")
    passed = F.map_keys(F.map_filter("components", lambda _, v: v == "PASS"))
    return violations(reports, keys, [
        ("unsupported schema version", wanted.isNull()),
        ("verdict is not PASS", F.coalesce("verdict", F.lit("")) != "PASS"),
        ("component missing or failed", F.size(F.array_except(wanted, passed)) > 0),
        ("test provider", F.col("provider").isin(*TEST_PROVIDERS)),
    ])


def render_policy(
    renders: DataFrame, styles: DataFrame, keys: Sequence[str], style: str = "style", rules: DataFrame | None = None
) -> DataFrame:
    """Captions and overlays of a render against its style.

    ``styles``: style, alignment, color, font_class, min_font_px, max_font_px; renders carry
    caption_*, centre_drift, title_px, title_top, caption_top, overlay_mode, copy_leaks.
    """
    joined = lookup_join(renders, styles, [style], "left")
    return violations(joined, keys, rules_of("render", rules))


def technical_rules(probes: DataFrame, keys: Sequence[str], rules: DataFrame | None = None) -> DataFrame:
    """Stream counts, size, frame rate, duration and level of a probe table."""
    return violations(probes, keys, rules_of("technical", rules))


def style_defaults(wanted: DataFrame, styles: DataFrame, fields: Sequence[str], style: str = "style", default: str = "default") -> DataFrame:
    """Own setting, else the style's, else the default style's; an unknown style is the default."""
    base = styles.filter(F.col(style) == default).select(*[F.col(f).alias(f"_d_{f}") for f in fields])
    named = styles.select(style, *[F.col(f).alias(f"_s_{f}") for f in fields], F.lit(True).alias("_known"))
    # One row; a second default style is an error, not a choice.
    count = F.count(F.lit(1))
    only = F.when(count > 1, F.raise_error(F.lit("more than one default style"))).otherwise(F.lit(1)).cast("int")
    base = base.agg(*[F.max(c).alias(c) for c in base.columns], only.alias("_one"))
    joined = lookup_join(wanted, named, [style], "left").withColumn("_one", F.lit(1)).join(
        F.broadcast(base), "_one", "left"
    )
    kept = [c for c in wanted.columns if c not in (*fields, style)]
    return joined.select(
        *kept, F.when(F.col("_known"), F.col(style)).otherwise(F.lit(default)).alias(style),
        *[F.coalesce(f, f"_s_{f}", f"_d_{f}").alias(f) for f in fields],
    )


def recipe_contract(recipes: DataFrame) -> DataFrame:
    """Violations of recipe rows: fields present, lists not empty, ids unique."""
    counts = recipes.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    joined = lookup_join(recipes, counts, ["id"], "left")
    missing = [(f"field missing: {name}", F.col(name).isNull()) for name in RECIPE_FIELDS if name in recipes.columns]
    return violations(joined, ["id"], [
        *missing, ("needs tags", F.coalesce(F.size("tags"), F.lit(0)) <= 0),
        ("needs situations", F.coalesce(F.size("situations"), F.lit(0)) <= 0), ("duplicate id", F.col("_n") > 1),
    ])


def recipe_search_text(recipes: DataFrame, text_fields: Sequence[str], list_fields: Sequence[str]) -> DataFrame:
    """Search text where a recipe brings none: its texts and lists, lower-cased."""
    built = F.lower(F.concat_ws(" ", *text_fields, *[F.array_join(name, " ") for name in list_fields]))
    return recipes.withColumn("search_text", F.coalesce("search_text", built))
