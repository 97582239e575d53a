"""Decisions, corrections and revisions applied to transcript entries, with their rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.functions.text import display_text
from timelinekit.operators.editorial import DEFAULT_CUT_REASON
from timelinekit.plans.layout import KeyLayout, lookup_join
from timelinekit.plans.ordered import ordered_scan

# ---- fixed values -------------------------------------------------------------------------
KINDS = ("keep", "cut")
VISUAL_TYPES = ("library-broll", "motion", "screen", "none")
TEXT_OPERATIONS = ("cut", "keep", "replace-text")
VISUAL_OPERATIONS = ("set-visual", "remove-visual")
COVERAGE_SLACK_S = 1.0
LIST_MIN_LINES = 3
# -------------------------------------------------------------------------------------------


def timeline_valid(
    entries: DataFrame, layout: KeyLayout, order: Sequence[str], known_words: Column | None = None
) -> DataFrame:
    """Add ``reject``: the first rule an entry breaks, or null. ``order`` is the stored order."""
    keys = list(layout.keys)
    repeats = entries.groupBy(*keys, "id").agg(F.min(F.struct(*order)).alias("_first"))
    seen = ordered_scan(entries, layout, order, max_before={"_reach": "end_s"})
    joined = lookup_join(seen, repeats, [*keys, "id"], "inner")
    finite = ~F.isnan("start_s") & ~F.isnan("end_s") & (F.abs("start_s") < float("inf")) & (F.abs("end_s") < float("inf"))
    reject = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.lit("no id"))
        .when(F.struct(*order) != F.col("_first"), F.lit("duplicate id"))
        .when(~F.coalesce(finite, F.lit(False)), F.lit("time is not finite"))
        .when(F.col("start_s") < 0, F.lit("negative start"))
        .when(F.col("end_s") <= F.col("start_s"), F.lit("empty range"))
        .when(F.col("start_s") < F.coalesce("_reach", F.lit(-1.0)) - 1e-6, F.lit("overlap"))
        .when(F.trim("text") == "", F.lit("empty text"))
    )
    if known_words is not None:
        reject = reject.when(F.size(F.array_except("word_ids", known_words)) > 0, F.lit("unknown word"))
    return joined.withColumn("reject", reject).drop("_first", "_reach")


def canonical_id(entry_id: Column) -> Column:
    """``u2`` and ``u0002`` name the same utterance, with or without part suffixes."""
    number = F.regexp_extract(entry_id, r"^u0*([0-9]+)((?:[px][0-9]+)*)$", 1)
    suffix = F.regexp_extract(entry_id, r"^u0*([0-9]+)((?:[px][0-9]+)*)$", 2)
    return F.when(number != "", F.concat(F.lit("u"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0")), suffix)).otherwise(entry_id)


def parent_id(entry_id: Column) -> Column:
    """Id of the utterance a part was split from, or null."""
    parent = F.regexp_extract(entry_id, r"^(u0*[0-9]+)((?:[px][0-9]+)+)$", 1)
    return F.when(parent != "", canonical_id(parent))


def enrich_from_source(entries: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Times and words of each entry from its utterance; parts keep their own bounds.

    ``reject`` names entries without a source and parts without bounds.
    """
    keys = list(keys)
    own = source.select(*keys, canonical_id(F.col("id")).alias("_own"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"),
                        F.col("word_count").alias("_w"))
    parent = own.select(*keys, F.col("_own").alias("_parent"), F.col("_w").alias("_pw"))
    named = entries.withColumn("_own", canonical_id(F.col("id"))).withColumn("_parent", parent_id(F.col("id")))
    joined = lookup_join(lookup_join(named, own, [*keys, "_own"], "left"), parent, [*keys, "_parent"], "left")
    found, split = F.col("_s").isNotNull(), F.col("_pw").isNotNull()
    reject = (
        F.when(~found & F.col("_parent").isNull(), F.lit("unknown id"))
        .when(~found & ~split, F.lit("unknown parent"))
        .when(~found & (F.coalesce("end_s", F.lit(0.0)) <= F.coalesce("start_s", F.lit(0.0))), F.lit("part without bounds"))
    )
    return joined.select(
        *keys, "id", F.coalesce("_s", "start_s").alias("start_s"), F.coalesce("_e", "end_s").alias("end_s"),
        F.coalesce("_w", "_pw").alias("word_count"), reject.alias("reject"),
    )


def apply_text_rules(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements in their order."""
    for match, replacement in rules:
        if not match:
            raise ValueError("a rule needs a non-empty match")
        text = F.replace(text, F.lit(match), F.lit(replacement))
    return text


def rule_regression(cases: DataFrame, keys: Sequence[str], before: Column, after: Column, expected: Column) -> DataFrame:
    """A rule passes when no case was right before and all are right after."""
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"),
        F.when(F.bool_or(before == expected) | ~F.bool_and(after == expected), F.lit("FAIL")).otherwise(F.lit("PASS")).alias("verdict"),
    )


def overlay_corrections(
    words: DataFrame, rewrites: DataFrame, layout: KeyLayout, order: Sequence[str], pair: tuple[str, str, str] = ("про", "женщ", "PRO Женщин")
) -> DataFrame:
    """Text on screen: a human rewrite verbatim, else display text; a brand said as two words
    becomes one caption word that ends with the second."""
    keys = list(layout.keys)
    first, second, brand = pair
    # A rewrite stands beside its word in one window, so words that lie by their keys aren't moved by their ids.
    given = rewrites.select(*keys, "word_id", F.col("rewrite").alias("_given")).dropna()
    both = words.withColumn("_said", F.lit(True)).unionByName(given, allowMissingColumns=True)
    joined = both.withColumn("rewrite", F.max("_given").over(Window.partitionBy(*keys, "word_id"))).filter("_said").drop("_said", "_given")
    spoken = joined.withColumn("_word", F.coalesce("rewrite", "text")).withColumn(
        "_fold", F.replace(F.lower(F.coalesce("rewrite", "text")), F.lit("ё"), F.lit("е"))
    )
    # Two heads cannot follow each other, so pairs never overlap.
    seen = ordered_scan(spoken, layout, order, nxt={"_next": "_fold", "_next_end": "end_s"}, prev={"_prev": "_fold"})
    opens = (F.col("_fold") == first) & F.coalesce(F.col("_next").startswith(second), F.lit(False))
    closes = F.col("_fold").startswith(second) & (F.coalesce(F.col("_prev"), F.lit("")) == first)
    shown = F.when(opens, F.lit(brand)).when(F.col("rewrite").isNotNull(), F.col("rewrite")).otherwise(display_text(F.col("text")))
    return seen.filter(~closes).select(
        *keys, "word_id", shown.alias("caption"), "start_s", F.when(opens, F.col("_next_end")).otherwise(F.col("end_s")).alias("end_s")
    )


def orphan_anchors(overlays: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlays with their first fault: repeated id, bad type or duration, unknown or cut anchor."""
    keys = list(keys)
    counts = overlays.groupBy(*keys, "overlay_id").agg(F.count(F.lit(1)).alias("_n"))
    kinds = entries.select(*keys, F.col("id").alias("anchor"), F.col("kind").alias("_kind"))
    counted = lookup_join(overlays, counts, [*keys, "overlay_id"], "inner")
    joined = lookup_join(counted, kinds, [*keys, "anchor"], "left")
    fault = (
        F.when(F.col("_n") > 1, F.lit("duplicate overlay id"))
        .when(~F.col("type").isin(*VISUAL_TYPES), F.lit("unsupported type"))
        .when(F.coalesce("duration_s", F.lit(1.0)) <= 0, F.lit("bad duration"))
        .when(F.col("_kind").isNull(), F.lit("unknown anchor"))
        .when(F.col("_kind") != "keep", F.lit("anchor is cut"))
    )
    return joined.withColumn("fault", fault).drop("_n", "_kind")


def apply_decisions(entries: DataFrame, decisions: DataFrame, keys: Sequence[str], cohesion: Column) -> DataFrame:
    """Entries with their decision; an entry nobody decided on is cut.

    ``reject``: KEEP on a block of several takes. Faulty decisions are in ``decision_faults``.
    """
    keys = list(keys)
    usable = decisions.groupBy(*keys, "id").agg(F.min_by(F.struct("kind", "reason"), F.coalesce("reason", F.lit(""))).alias("_d"))
    joined = entries.drop("kind", "reason").join(usable, [*keys, "id"], "left")
    kind = F.coalesce(F.col("_d.kind"), F.lit("cut"))
    reason = F.when(F.col("_d").isNull(), F.lit(DEFAULT_CUT_REASON)).when(kind == "cut", F.trim(F.col("_d.reason")))
    return (
        joined.withColumn("kind", kind).withColumn("reason", reason)
        .withColumn("reject", F.when((kind == "keep") & cohesion, F.lit("keep on several takes"))).drop("_d")
    )


def decision_faults(decisions: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decisions with a repeated or unknown id, an unknown kind, or a cut without reason."""
    keys = list(keys)
    counts = decisions.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n"))
    known = entries.select(*keys, "id", F.lit(True).alias("_known"))
    joined = lookup_join(decisions, counts, [*keys, "id"], "inner").join(known, [*keys, "id"], "left")
    fault = (
        F.when(F.col("_n") > 1, F.lit("duplicate id"))
        .when(~F.col("kind").isin(*KINDS), F.lit("invalid kind"))
        .when((F.col("kind") == "cut") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), F.lit("cut without reason"))
        .when(F.col("_known").isNull(), F.lit("unknown id"))
    )
    return joined.withColumn("fault", fault).filter("fault IS NOT NULL").drop("_n", "_known")


def decision_coverage(entries: DataFrame, media: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Do the entries reach the end of the media, up to a second?"""
    ends = entries.groupBy(*keys).agg(F.max("end_s").alias("coverage_end_s"))
    out = media.join(ends, list(keys), "left")
    return out.withColumn("covered", F.coalesce(F.col("coverage_end_s") + COVERAGE_SLACK_S >= F.col("duration_s"), F.lit(False)))


def scene_contract(scenes: DataFrame, recipes: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First fault of each scene. ``scenes``: key, scene_id, recipe, anchor, fields map<string,string>,
    lines; ``recipes``: recipe, reserved, required array, needs_list."""
    keys = list(keys)
    counts = scenes.groupBy(*keys, "scene_id").agg(F.count(F.lit(1)).alias("_n"))
    kinds = entries.select(*keys, F.col("id").alias("anchor"), F.col("kind").alias("_kind"))
    counted = lookup_join(scenes, counts, [*keys, "scene_id"], "inner")
    with_recipe = lookup_join(counted, recipes.withColumn("_known", F.lit(True)), ["recipe"], "left")
    joined = lookup_join(with_recipe, kinds, [*keys, "anchor"], "left")
    filled = F.map_keys(F.map_filter("fields", lambda _, v: F.trim(F.coalesce(v, F.lit(""))) != ""))
    fault = (
        F.when(F.col("_known").isNull(), F.lit("unknown recipe"))
        .when(F.col("reserved"), F.lit("reserved recipe"))
        .when(F.col("_n") > 1, F.lit("duplicate scene id"))
        .when(F.coalesce("_kind", F.lit("")) != "keep", F.lit("anchor is not kept"))
        .when(F.size(F.array_except("required", filled)) > 0, F.lit("field missing"))
        .when(F.col("needs_list") & (F.coalesce("lines", F.lit(0)) < LIST_MIN_LINES), F.lit("list too short"))
    )
    return joined.select(*keys, "scene_id", fault.alias("fault"))


def apply_revisions(entries: DataFrame, operations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries after cut / keep / replace-text and visual operations; the last one per entry
    and field wins. ``operations``: key, seq, id, operation, value."""
    keys = list(keys)

    def latest(names: Sequence[str], field: Column) -> Column:
        return F.max_by(field, F.when(F.col("operation").isin(*names), F.col("seq")))

    last = operations.groupBy(*keys, "id").agg(
        latest(("cut", "keep"), F.col("operation")).alias("_kind"),
        latest(("replace-text",), F.col("value")).alias("_text"),
        latest(VISUAL_OPERATIONS, F.struct("operation", "value")).alias("_visual"),
    )
    joined = entries.join(last, [*keys, "id"], "left")
    visual = F.when(F.col("_visual").isNull(), F.col("visual")).when(F.col("_visual.operation") == "set-visual", F.col("_visual.value"))
    return (
        joined.withColumn("kind", F.coalesce("_kind", "kind")).withColumn("text", F.coalesce("_text", "text"))
        .withColumn("visual", visual).drop("_kind", "_text", "_visual")
    )


def revision_errors(entries: DataFrame, operations: DataFrame, layout: KeyLayout) -> DataFrame:
    """Operations on unknown entries, of unknown kind, or that change nothing at their turn.

    ``layout`` is keyed by the operations' (key..., id) and ordered by ``seq``.
    """
    *keys, _ = layout.keys
    known = entries.select(*keys, "id", F.col("kind").alias("_kind"), F.col("text").alias("_text"), F.col("visual").alias("_visual"))
    joined = lookup_join(operations, known, [*keys, "id"], "left")
    slot = (
        F.when(F.col("operation").isin("cut", "keep"), F.lit("kind")).when(F.col("operation") == "replace-text", F.lit("text"))
        .when(F.col("operation").isin(*VISUAL_OPERATIONS), F.lit("visual"))
    )
    wanted = F.when(F.col("operation").isin("cut", "keep"), F.col("operation")).when(
        F.col("operation") == "remove-visual", F.lit("")
    ).otherwise(F.coalesce("value", F.lit("")))
    staged = joined.withColumn("_slot", F.coalesce(slot, F.lit("?"))).withColumn("_wanted", wanted)
    per_slot = KeyLayout((*layout.keys, "_slot"), layout.order)
    seen = ordered_scan(staged, per_slot, [layout.order], prev={"_was": "_wanted"})
    at_first = F.when(F.col("_slot") == "kind", F.col("_kind")).when(F.col("_slot") == "text", F.col("_text")).otherwise(
        F.coalesce("_visual", F.lit(""))
    )
    error = (
        F.when(~F.col("operation").isin(*TEXT_OPERATIONS, *VISUAL_OPERATIONS), F.lit("unknown operation"))
        .when(F.col("_kind").isNull(), F.lit("unknown entry"))
        .when(F.col("_wanted") == F.coalesce("_was", at_first), F.lit("no change"))
    )
    return seen.select(*keys, "id", layout.order, "operation", error.alias("error")).filter("error IS NOT NULL")
