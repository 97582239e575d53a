"""Timeline algebra: free gaps, subtraction, assignment, rebasing, sentences, captions, spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.functions.text import normalize_tokens
from timelinekit.plans.layout import KeyLayout, lookup_join
from timelinekit.plans.ordered import islands, ordered_scan
from timelinekit.plans.ranges import merge_spans, overlap_join, point_join
from timelinekit.session import cut_lineage

# ---- fixed values -------------------------------------------------------------------------
MIN_HOLD_S = 0.12
MIN_GAP_S = 0.45
MAX_GAPS = 4
FRAME_GUARD_S = 0.05
KEEP_JOIN_GAP_S = 1.5
EDIT_REASON = "edit"
SENTENCE_END = r"[.!?…]+[\"»)]*$"
OVERLAY_MIN_S, OVERLAY_DEFAULT_S, OVERLAY_MAX_S = 1.8, 3.0, 4.5
# -------------------------------------------------------------------------------------------


def clamp_timestamp(value: Column, duration: Column) -> Column:
    """A time that still has a frame: inside [0, duration - guard]."""
    inside = F.least(F.greatest(F.lit(0.0), value), F.greatest(F.lit(0.0), duration - FRAME_GUARD_S))
    return F.when(duration <= FRAME_GUARD_S, F.lit(0.0)).otherwise(inside)


def free_gaps(
    windows: DataFrame, durations: DataFrame, layout: KeyLayout, min_gap: float = MIN_GAP_S, first: int = MAX_GAPS
) -> DataFrame:
    """Midpoints of the first free spans of [0, duration] outside the windows.

    Windows and the media end are scanned once with a running maximum of window ends.
    """
    keys = list(layout.keys)
    marks = windows.filter(F.col("end_s") > F.col("start_s")).select(
        *keys, F.col("start_s").alias("x"), F.lit(0).alias("_kind"), F.col("end_s").alias("_reach")
    )
    closing = durations.filter("duration_s > 0.1").select(
        *keys, F.col("duration_s").alias("x"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_reach")
    )
    with_end = layout.join_per_key(marks, closing.select(*keys), "left_semi").unionByName(closing)
    # The closing mark is compared last even when windows start after the media ends.
    seen = ordered_scan(
        with_end.withColumn("_at", F.when(F.col("_kind") == 1, F.lit(float("inf"))).otherwise(F.col("x"))),
        KeyLayout(layout.keys, "_at", layout.hot), ["_at", "_kind", "_reach"], max_before={"_cursor": "_reach"},
    )
    gaps = seen.withColumn("_from", F.greatest(F.lit(0.0), F.coalesce("_cursor", F.lit(0.0)))).filter(
        F.col("x") > F.col("_from") + min_gap
    )
    numbered = ordered_scan(gaps, KeyLayout(layout.keys, "_from", layout.hot), ["_from", "x"], number="gap_no").filter(
        F.col("gap_no") <= first
    )
    mid = (F.col("_from") + F.col("x")) / 2
    out = numbered.join(durations.select(*keys, "duration_s"), keys)
    return out.select(*keys, "gap_no", clamp_timestamp(mid, F.col("duration_s")).alias("stamp_s"))


def interval_subtract(
    spans: DataFrame, windows: DataFrame, layout: KeyLayout, span_id: str, min_hold: float = MIN_HOLD_S
) -> DataFrame:
    """Parts of each span outside all windows, at least ``min_hold`` long.

    Windows are merged, their complement is again a list of intervals, and the answer is the
    overlap of spans with that complement.
    """
    keys = list(layout.keys)
    merged = merge_spans(windows.filter(F.col("end_s") > F.col("start_s")), KeyLayout(layout.keys, "start_s", layout.hot),
                         ("start_s", "end_s"))
    after = ordered_scan(merged, KeyLayout(layout.keys, "start_s", layout.hot), ["start_s"], nxt={"_next": "start_s"},
                         prev={"_prev": "start_s"})
    reach = spans.groupBy(*keys).agg(F.min("start_s").alias("_lo"), F.max("end_s").alias("_hi"))
    free = (
        layout.join_per_key(after, reach)
        .select(*keys, F.col("end_s").alias("_fs"), F.coalesce("_next", F.greatest("_hi", "end_s")).alias("_fe"))
        .unionByName(after.filter("_prev IS NULL").join(reach, keys)
                     .select(*keys, F.least("_lo", "start_s").alias("_fs"), F.col("start_s").alias("_fe")))
        .unionByName(reach.join(merged.select(*keys).distinct(), keys, "left_anti")
                     .select(*keys, F.col("_lo").alias("_fs"), F.col("_hi").alias("_fe")))
        .filter("_fe > _fs")
    )
    touched = overlap_join(spans, free, keys, ("start_s", "end_s"), ("_fs", "_fe"))
    pieces = touched.select(
        *keys, span_id, F.greatest("start_s", "_fs").alias("start_s"), F.least("end_s", "_fe").alias("end_s")
    )
    return pieces.filter(F.col("end_s") - F.col("start_s") >= min_hold)


def assign_by_midpoint(
    words: DataFrame, entries: DataFrame, keys: Sequence[str], pad: float = 0.05
) -> DataFrame:
    """(word, entry) pairs where the word's middle lies in the padded entry."""
    middle = words.withColumn("_mid", (F.col("start_s") + F.col("end_s")) / 2)
    spans = entries.select(
        *keys, F.col("id").alias("entry_id"), (F.col("start_s") - pad).alias("_from"), (F.col("end_s") + pad).alias("_to")
    )
    return point_join(middle, spans, keys, "_mid", ("_from", "_to")).drop("_mid", "_from", "_to")


def assign_by_majority(
    words: DataFrame, entries: DataFrame, keys: Sequence[str], word_ids: str | None = None, word_id: str = "word_id"
) -> DataFrame:
    """Words go to the entry that holds at least half of them; times become local to it.

    With ``word_ids``, an array column of the entries, a word only goes to entries that list its
    ``word_id``, and the two meet by that id: an entry is exploded, never searched. ``place`` is
    then the word's place in the list, from 0.
    """
    spans = entries.select(
        *keys, F.col("id").alias("entry_id"), F.col("start_s").alias("_es"), F.col("end_s").alias("_ee"),
        *([] if word_ids is None else [F.col(word_ids).alias("_ids")]),
    )
    if word_ids is None:
        pairs = overlap_join(words, spans, keys, ("start_s", "end_s"), ("_es", "_ee"))
    else:
        listed = spans.select("*", F.posexplode("_ids").alias("place", word_id)).drop("_ids")
        pairs = words.join(listed, [*keys, word_id]).filter((F.col("start_s") < F.col("_ee")) & (F.col("_es") < F.col("end_s")))
    overlap = F.least("end_s", "_ee") - F.greatest("start_s", "_es")
    owned = pairs.filter(overlap >= 0.5 * F.greatest(F.col("end_s") - F.col("start_s"), F.lit(1e-6)))
    local_start = F.greatest(F.lit(0.0), F.col("start_s") - F.col("_es"))
    local_end = F.least(F.col("_ee") - F.col("_es"), F.greatest(local_start + 0.04, F.col("end_s") - F.col("_es")))
    return owned.withColumn("local_start_s", local_start).withColumn("local_end_s", local_end).drop("_es", "_ee")


def rebase_words(
    entries: DataFrame, words: DataFrame, layout: KeyLayout, order: Sequence[str], word_ids: str | None = None, word_id: str = "word_id"
) -> DataFrame:
    """Words of the KEEP entries on the new timeline: (keys, id, offset_s, word_no, source_word_id, token, start_s, end_s, timing).

    ``entries`` have id, kind, start_s, end_s, text; ``words`` have ``word_id``, start_s, end_s,
    text. A word is spoken in the entry that owns the larger part of it, by its first normal token;
    words without one are silent. An entry that owns no such word is cut into even slices, one per
    token of its text. ``word_no`` counts the words of an entry from 1.
    """
    keys = list(layout.keys)
    length = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    kept = rebase_timeline(entries.withColumn("duration_s", length), layout, order).drop("new_end_s")
    owned = assign_by_majority(words.withColumnRenamed("text", "_said"), kept, keys, word_ids, word_id)
    placed = ["place"] if word_ids is not None else ["local_start_s", "source_word_id"]
    spoken = owned.withColumn("token", F.try_element_at(normalize_tokens(F.col("_said")), F.lit(1))).filter("token IS NOT NULL")
    timed = spoken.select(
        *keys, F.col("entry_id").alias("id"), F.col(word_id).alias("source_word_id"), "token", "local_start_s", "local_end_s",
        *[c for c in placed if c == "place"],
    )
    # an entry's words lie inside one entry, which is one input row
    nth = F.row_number().over(Window.partitionBy(*keys, "id").orderBy(*placed))
    timed = cut_lineage(timed.withColumn("word_no", nth).drop("place"))
    base = kept.select(*keys, "id", "offset_s", "duration_s", "text")
    by_source = timed.join(base.drop("text", "duration_s"), [*keys, "id"]).withColumn("timing", F.lit("source-words"))
    bare = base.join(timed.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")
    sliced = bare.withColumn("_tokens", normalize_tokens(F.col("text"))).select("*", F.posexplode("_tokens").alias("_i", "token"))
    step = F.col("duration_s") / F.size("_tokens")
    even = sliced.select(
        *keys, "id", F.lit(None).cast(timed.schema["source_word_id"].dataType).alias("source_word_id"), "token", (F.col("_i") * step).alias("local_start_s"),
        ((F.col("_i") + 1) * step).alias("local_end_s"), (F.col("_i") + 1).alias("word_no"), "offset_s", F.lit("even-slices").alias("timing"),
    )
    return by_source.unionByName(even).select(
        *keys, "id", "offset_s", "word_no", "source_word_id", "token", (F.col("offset_s") + F.col("local_start_s")).alias("start_s"),
        (F.col("offset_s") + F.col("local_end_s")).alias("end_s"), "timing",
    )


def rebase_timeline(entries: DataFrame, layout: KeyLayout, order: Sequence[str]) -> DataFrame:
    """KEEP entries laid end to end: offset is the duration of all KEEP rows before."""
    kept = entries.filter("kind = 'keep'")
    out = ordered_scan(kept, layout, order, before={"offset_s": "duration_s"})
    return out.withColumn("new_end_s", F.col("offset_s") + F.col("duration_s"))


def chapter_offsets(parts: DataFrame, layout: KeyLayout, order: Sequence[str]) -> DataFrame:
    """Where each part of a film starts, and its ordinal."""
    return ordered_scan(parts, layout, order, before={"offset_s": "duration_s"}, number="chapter")


def merge_adjacent_keeps(
    entries: DataFrame, layout: KeyLayout, order: Sequence[str], max_gap: float = KEEP_JOIN_GAP_S
) -> DataFrame:
    """Consecutive KEEP rows with a gap in [0, max_gap] become one entry with suffix ``x1``.

    Texts are put together per run; a run is one spoken passage.
    """
    gap = F.col("start_s") - F.col("_end")
    joins = (F.col("kind") == "keep") & (F.col("_kind") == "keep") & (gap >= 0) & (gap <= max_gap)
    runs = islands(entries, layout, order, ~joins, prev={"_kind": "kind", "_end": "end_s"}, out="_run")
    by_order = F.struct(*order)
    merged = runs.groupBy(*layout.keys, "_run").agg(
        F.min_by("id", by_order).alias("_id"), F.min_by("kind", by_order).alias("kind"),
        F.min("start_s").alias("start_s"), F.max_by("end_s", by_order).alias("end_s"),
        F.count(F.lit(1)).alias("parts"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col("text").alias("_text")))),
                                 lambda r: r["_text"]), " ").alias("text"),
    )
    suffixed = F.when((F.col("parts") > 1) & ~F.col("_id").endswith("x1"), F.concat("_id", F.lit("x1"))).otherwise(F.col("_id"))
    return merged.select(*layout.keys, suffixed.alias("id"), "kind", "start_s", "end_s", "parts", "text")


def flag_spans(
    words: DataFrame, layout: KeyLayout, order: Sequence[str], keep: Column
) -> DataFrame:
    """Runs of equal keep flag inside each entry (a key of ``layout``) as parts ``x1``, ``x2``...

    ``parts`` counts the runs of an entry; with one run the entry stays whole.
    """
    flagged = words.withColumn("_keep", keep)
    runs = islands(flagged, layout, order, F.col("_was") != F.col("_keep"), prev={"_was": "_keep"}, out="part")
    spans = runs.groupBy(*layout.keys, "part").agg(
        F.bool_and("_keep").alias("keep"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        F.count(F.lit(1)).alias("words"),
    )
    totals = spans.groupBy(*layout.keys).agg(F.count(F.lit(1)).alias("parts"))
    return layout.join_per_key(spans, totals)


def edited_entries(
    entries: DataFrame, words: DataFrame, layout: KeyLayout, order: Sequence[str], keep: Column, word_id: str, reason: str = EDIT_REASON
) -> DataFrame:
    """Entries after words were struck out (``keep`` false); ``layout`` is keyed by collection and ``id``.

    An entry without words stays as it is; one whose words all stay becomes a whole KEEP, one that
    lost them all a whole CUT, each with its own times and text. Any other is cut where the flag
    changes into parts ``x1``, ``x2``... with times, text and ``word_ids`` of their own words (words
    without an id give none). Words of an entry are put together per run; an entry is one input row.
    """
    keys = list(layout.keys)
    runs = islands(words.withColumn("_keep", keep), layout, order, F.col("_was") != F.col("_keep"), prev={"_was": "_keep"}, out="part")
    place = F.struct(*order)
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col("text").alias("_said"), F.col(word_id).cast("string").alias("_wid"))))
    spans = runs.groupBy(*keys, "part").agg(
        F.bool_and("_keep").alias("_keep"), F.min_by("start_s", place).alias("_from"), F.max_by("end_s", place).alias("_to"), rows.alias("_rows"),
    )
    # What is joined below is the finished text and ids, a fraction of the words as rows.
    spans = cut_lineage(spans.select(
        *keys, "part", "_keep", "_from", "_to", F.array_join(F.transform("_rows", lambda r: r["_said"]), " ").alias("_text"),
        F.filter(F.transform("_rows", lambda r: r["_wid"]), lambda w: F.coalesce(w != "", F.lit(False))).alias("_ids"),
    ))
    totals = spans.groupBy(*keys).agg(F.max("part").alias("_parts"), F.bool_and("_keep").alias("_all"))
    judged = entries.join(totals, keys, "left")
    kind = lambda kept: F.when(kept, "keep").otherwise("cut")
    why = lambda kept: F.when(~kept, F.lit(reason))
    touched = F.col("_parts").isNotNull()
    whole = judged.filter(F.coalesce(F.col("_parts"), F.lit(1)) == 1).select(
        *keys, F.when(touched, kind(F.col("_all"))).otherwise(F.col("kind")).alias("kind"), "start_s", "end_s", "word_ids", "text",
        F.when(touched, why(F.col("_all"))).otherwise(F.col("reason")).alias("reason"),
    )
    parts = spans.join(judged.filter("_parts > 1").select(*keys), keys).select(
        *[k for k in keys if k != "id"], F.concat("id", F.lit("x"), "part").alias("id"), kind(F.col("_keep")).alias("kind"),
        F.col("_from").alias("start_s"), F.col("_to").alias("end_s"),
        F.col("_ids").alias("word_ids"), F.col("_text").alias("text"), why(F.col("_keep")).alias("reason"),
    )
    return whole.unionByName(parts)


def sentences(words: DataFrame, layout: KeyLayout, order: Sequence[str], index: str) -> DataFrame:
    """Sentences end at terminal punctuation or at the last word."""
    marked = ordered_scan(
        words.withColumn("_end", F.col("text").rlike(SENTENCE_END).cast("long")), layout, order, before={"_no": "_end"}
    )
    by_order = F.struct(*order)
    return marked.groupBy(*layout.keys, (F.col("_no") + 1).alias("sentence")).agg(
        F.min_by(index, by_order).alias("from_word"), F.max_by(index, by_order).alias("to_word"),
        F.min("start_s").alias("start_s"),
    )


def caption_events(
    words: DataFrame, durations: DataFrame, layout: KeyLayout, order: Sequence[str], size: int = 6
) -> DataFrame:
    """Windows of ``size`` words; an end is extended a little but leaves room for the next start."""
    timed = layout.join_per_key(words.filter(F.trim("text") != ""), durations.select(*layout.keys, "duration_s"))
    start = F.greatest(F.lit(0.0), F.col("start_s"))
    timed = timed.withColumn("_s", start).withColumn(
        "_e", F.least(F.col("duration_s"), F.greatest(start + 0.04, F.col("end_s")))
    )
    numbered = ordered_scan(timed, layout, order, number="_n").withColumn("event", F.floor((F.col("_n") - 1) / size))
    by_order = F.struct(*order)
    grouped = numbered.groupBy(*layout.keys, "event").agg(
        F.min_by("_s", by_order).alias("_s"), F.max_by("_e", by_order).alias("_e"), F.max("duration_s").alias("duration_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col("text").alias("_text")))),
                                 lambda r: r["_text"]), " ").alias("phrase"),
    )
    by_event = KeyLayout.measure(grouped, layout.keys, "event") if layout.split else KeyLayout(layout.keys, "event")
    follow = ordered_scan(grouped, by_event, ["event"], nxt={"_next": "_s"})
    inner = F.least(F.col("_e") + 0.08, F.greatest(F.col("_s") + MIN_HOLD_S, F.col("_next") - 0.04))
    last = F.least(F.col("duration_s"), F.col("_e") + 0.18)
    return follow.select(
        *layout.keys, "event", F.bround("_s", 6).alias("start_s"),
        F.bround(F.when(F.col("_next").isNull(), last).otherwise(inner), 6).alias("end_s"), "phrase",
    )


def anchor_window(
    start: Column | None, anchor_start: Column, anchor_end: Column, offset: float = 0.0, wanted: float = OVERLAY_DEFAULT_S
) -> tuple[Column, Column]:
    """(start, end) of an overlay on its anchor: explicit or offset start, clamped duration."""
    shifted = anchor_start + max(0.0, offset)
    resolved = F.when(shifted >= anchor_end, anchor_start).otherwise(shifted)
    if start is not None:
        resolved = F.coalesce(start, resolved)
    duration = min(max(wanted, OVERLAY_MIN_S), OVERLAY_MAX_S)
    end = F.least(resolved + duration, anchor_end)
    short = (end - resolved < OVERLAY_MIN_S) & (anchor_end - resolved >= OVERLAY_MIN_S)
    end = F.when(short, F.least(resolved + OVERLAY_MIN_S, anchor_end)).otherwise(end)
    end = F.when(end <= resolved, F.least(anchor_end, resolved + OVERLAY_MIN_S)).otherwise(end)
    return resolved, end


def overlays_on_timeline(entries: DataFrame, overlays: DataFrame, layout: KeyLayout, order: Sequence[str]) -> DataFrame:
    """Overlay windows on the concatenated KEEP timeline. Overlays: key, overlay_id, anchor, from_s."""
    based = rebase_timeline(entries.withColumn("duration_s", F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))),
                            layout, order)
    keys = list(layout.keys)
    joined = lookup_join(
        overlays, based.select(*keys, F.col("id").alias("anchor"), F.col("start_s").alias("_as"), F.col("end_s").alias("_ae"),
                     "duration_s", "offset_s"),
        [*keys, "anchor"], "inner",
    )
    start, end = anchor_window(F.col("from_s"), F.col("_as"), F.col("_ae"))
    local_start = F.greatest(F.lit(0.0), start - F.col("_as"))
    local_end = F.least(F.col("duration_s"), F.greatest(local_start + 0.2, end - F.col("_as")))
    return joined.select(
        *keys, "overlay_id", "anchor", F.bround(F.col("offset_s") + local_start, 3).alias("render_start_s"),
        F.bround(F.col("offset_s") + local_end, 3).alias("render_end_s"),
    )


def lead_in_silence(
    words: DataFrame, entries: DataFrame, keys: Sequence[str], threshold: float = 0.8
) -> DataFrame:
    """Entries whose first word starts more than ``threshold`` late; entries without words are skipped."""
    spans = entries.select(*keys, F.col("id").alias("entry_id"), (F.col("start_s") - 1e-6).alias("_from"),
                           (F.col("end_s") - 1e-6).alias("_to"), F.col("start_s").alias("_es"))
    owned = point_join(words, spans, keys, "start_s", ("_from", "_to")).filter(F.col("start_s") < F.col("_to"))
    firsts = owned.groupBy(*keys, "entry_id").agg((F.min("start_s") - F.min("_es")).alias("_lead"))
    return firsts.filter(F.col("_lead") > threshold).select(*keys, "entry_id", F.bround("_lead", 3).alias("lead_in_s"))


