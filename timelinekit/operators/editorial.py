"""Editing of utterances: merging fragments, repeats, takes, proposed cuts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelinekit.functions.text import tokens
from timelinekit.plans.layout import KeyLayout, lookup_join
from timelinekit.plans.ordered import islands, ordered_scan
from timelinekit.plans.similarity import distinct_texts, similar_components, similar_pairs
from timelinekit.session import cut_lineage

# ---- fixed values -------------------------------------------------------------------------
RETAKE_MARKER = (
    r"\bзаново\b|\bвозвращаемся\b|\bхерня\b|"
    r"не\s+был\s+последний\s+дубль|последние\s+думали|"
    r"у\s+меня\s+все\s+понравилось|у\s+меня\s+все\s+погасло|"
    r"from\s+the\s+top|take\s+two"
)
TAKE_PREFIX = (
    r"(?:по\s+)?моим\s+наблюдениям\s+деньги\s+уходят|"
    r"деньги\s+уходят\s+не\s+потому"
)
HOOK_STARTS = (
    r"(?:по\s+)?моим\s+наблюдениям\s+деньги\s+уходят|"
    r"деньги\s+уходят\s+не\s+потому|"
    r"короче\s+говоря|"
    r"они\s+уходят\s+не\s+потому|"
    r"они\s+уходят,\s+потому"
)
SENTENCE_END = r'[.!?…]+["»”]?$'
CLAUSE_CONTINUES = r"[,:;…—–-]\s*$"
OPENING_MARKS = "«\"'("
REPEAT_SIMILARITY = 0.88
BLOCK_PAUSE_S = 5.0
ORPHAN_WORDS, ORPHAN_GAP_S, INCOMPLETE_GAP_S = 2, 0.5, 0.8
TAIL_WORDS = 8
TAKE_REASONS = ("latest-explicit-take", "latest-repetition-cluster", "latest-similar-block", "latest-similar-prefix")
TAKE_PROPOSALS = ("proposed-take", "proposed-repetition", "proposed-retake-block", "proposed-retake-prefix")
DEFAULT_CUT_REASON = "внутренние повторы"
# -------------------------------------------------------------------------------------------

MARKER = f"(?iU)(?:{RETAKE_MARKER})"
HOOK = f"(?iU)(?:{TAKE_PREFIX})"


def retake_marker(text: Column, pattern: str = MARKER) -> Column:
    return F.trim(text).rlike(pattern)


def take_prefix(text: Column, pattern: str = HOOK) -> Column:
    """The hook phrase, folded, or null."""
    found = F.regexp_extract(text, f"({pattern})", 1)
    return F.when(found != "", F.lower(found))


def hook_start_count(text: Column, starts: str = HOOK_STARTS) -> Column:
    return F.regexp_count(F.trim(text), F.lit(rf"(?iU)(?:^|(?<=[.!?…]\s))(?:{starts})"))


def false_cohesion(text: Column, starts: str = HOOK_STARTS, marker: str = MARKER) -> Column:
    """Several takes in one block: two hook starts, or a marker next to one."""
    hooks = hook_start_count(text, starts)
    return (hooks >= 2) | (retake_marker(text, marker) & (hooks >= 1))


def mid_clause(text: Column) -> Column:
    """Starts with a lower-case letter, an opening quote or a bracket."""
    first = F.left(F.regexp_replace(text, r"(?U)^\s+", ""), F.lit(1))
    return first.rlike(r"^\p{Ll}$") | ((first != "") & F.lit(OPENING_MARKS).contains(first))


def _starts_with(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})")


def _collapse(runs: DataFrame, keys: Sequence[str], order: Sequence[str], run: str) -> DataFrame:
    """One utterance per run: first id and start, last end, texts joined. A run becomes one
    output row, so its texts meet in one place by definition."""
    by_order = F.struct(*order)
    return runs.groupBy(*keys, run).agg(
        F.min_by("id", by_order).alias("id"), F.min("start_s").alias("start_s"), F.max_by("end_s", by_order).alias("end_s"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("_text")))),
                                 lambda r: r["_text"]), " ").alias("text"),
        F.min_by("decision", by_order).alias("decision"), F.count(F.lit(1)).alias("parts"),
    ).drop(run)


def merge_fragments(
    utterances: DataFrame, layout: KeyLayout, order: Sequence[str], max_words: int = ORPHAN_WORDS,
    max_gap: float = ORPHAN_GAP_S, hook: str = HOOK,
) -> DataFrame:
    """Very short utterances right after another join it, unless they open a take or carry
    another decision. Every row must have a decision."""
    joins = (
        (F.size(tokens(F.col("text"))) <= max_words)
        & (F.col("start_s") - F.col("_end") <= max_gap)
        & ~_starts_with(F.col("text"), hook)
        & (F.col("decision") == F.col("_decision"))
    )
    runs = islands(utterances, layout, order, ~joins, prev={"_end": "end_s", "_decision": "decision"}, out="_run")
    return _collapse(runs, layout.keys, order, "_run")


def merge_incomplete(
    utterances: DataFrame, layout: KeyLayout, order: Sequence[str], max_gap: float = INCOMPLETE_GAP_S,
    marker: str = MARKER, hook: str = HOOK,
) -> DataFrame:
    """Rejoin sentences split in the middle.

    All tests but one look at neighbouring rows and cut the key into short runs; the last one
    (no marker in the text merged so far) is a fold over the texts of such a run.
    """
    text, before = F.col("text"), F.regexp_replace(F.col("_text"), r"(?U)\s+$", "")
    joins = (
        (F.col("start_s") - F.col("_end") <= max_gap)
        & ~before.rlike(SENTENCE_END)
        & ~_starts_with(text, hook)
        & ~F.left(text, F.lit(80)).rlike(marker)
        & (before.rlike(CLAUSE_CONTINUES) | mid_clause(text))
        & (F.col("decision") == F.col("_decision"))
    )
    runs = islands(utterances, layout, order, ~joins,
                   prev={"_end": "end_s", "_text": "text", "_decision": "decision"}, out="_run")
    keys = list(layout.keys)
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("id").alias("id"), F.col("start_s").alias("s"),
                   F.col("end_s").alias("e"), "text", "decision")
    listed = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def piece(r: Column, parts: Column) -> Column:
        return F.struct(r["id"].alias("id"), r["s"].alias("start_s"), r["e"].alias("end_s"), r["text"].alias("text"),
                        r["decision"].alias("decision"), parts.alias("parts"))

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["id"].alias("id"), last["start_s"].alias("start_s"), r["e"].alias("end_s"),
                          F.trim(F.concat_ws(" ", last["text"], r["text"])).alias("text"), last["decision"].alias("decision"),
                          (last["parts"] + 1).alias("parts"))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        return F.when(retake_marker(last["text"], marker), F.concat(done, F.array(piece(r, F.lit(1))))).otherwise(grown)

    head = F.array(piece(F.col("_rows")[0], F.lit(1)))
    rest = F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))
    merged = listed.select(*keys, F.explode(F.aggregate(rest, head, step)).alias("_u"))
    return merged.select(*keys, "_u.*")


def merge_take_blocks(
    utterances: DataFrame, layout: KeyLayout, order: Sequence[str], marker: str = MARKER, hook: str = HOOK
) -> DataFrame:
    """A hook opens a block, a marker closes it after its row, rows outside stay alone."""
    opens, closes = _starts_with(F.trim(F.col("text")), hook), retake_marker(F.col("text"), marker)
    status = F.when(closes, F.lit(0)).when(opens, F.lit(1))
    seen = ordered_scan(utterances.withColumn("_status", status), layout, order, last={"_after": "_status"})
    starts = opens | (F.coalesce(F.col("_before"), F.lit(0)) != 1)
    runs = islands(seen, layout, order, starts, prev={"_before": "_after"}, out="_run")
    return _collapse(runs, layout.keys, order, "_run")


def absorb_tails(
    entries: DataFrame, layout: KeyLayout, order: Sequence[str], protected: Column
) -> DataFrame:
    """Short mid-clause KEEP rows right behind a proposed or marker CUT join that CUT.

    A row is absorbed when the nearest row before it that could not be absorbed is such a
    cut, which a carried value answers without a sequential pass.
    """
    reason = F.coalesce(F.trim("reason"), F.lit(""))
    allows = (F.col("kind") == "cut") & (reason.startswith("proposed-") | reason.isin("hanging-clause", "retake-marker"))
    loose = (F.col("kind") == "keep") & ~protected & mid_clause(F.col("text")) & (F.size(tokens(F.col("text"))) <= TAIL_WORDS)
    marked = entries.withColumn("_loose", loose).withColumn("_base", F.when(~loose, allows))
    seen = ordered_scan(marked, layout, order, last={"_behind": "_base"})
    absorbed = F.col("_loose") & F.coalesce(F.col("_behind"), F.lit(False))
    runs = ordered_scan(seen.withColumn("_opens", (~absorbed).cast("long")), layout, order, upto={"_run": "_opens"})
    by_order = F.struct(*order)
    return runs.groupBy(*layout.keys, "_run").agg(
        F.min_by("id", by_order).alias("id"), F.min_by("kind", by_order).alias("kind"), F.min("start_s").alias("start_s"),
        F.max_by("end_s", by_order).alias("end_s"), F.min_by("reason", by_order).alias("reason"), F.count(F.lit(1)).alias("parts"),
    ).drop("_run")


def explicit_takes(utterances: DataFrame, keys: Sequence[str], group: str, order: str) -> DataFrame:
    """Members of named take groups of two or more; the last one is kept."""
    named = utterances.filter(F.trim(group) != "")
    return _latest_kept(named, [*keys, group], order)


def _latest_kept(members: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Mark the latest member of each group of at least two (counts are partial aggregates)."""
    groups = members.groupBy(*by).agg(
        F.max(order).alias("_latest"), F.min(order).alias("_first"), F.count(F.lit(1)).alias("members")
    ).filter("members >= 2")
    out = lookup_join(members, groups, list(by), "inner")
    return out.withColumn("kept", F.col(order) == F.col("_latest")).drop("_latest", "_first")


def repeat_texts(utterances: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distinct token lists of the utterances; texts without tokens have no similarity."""
    with_tokens = utterances.withColumn("_tokens", tokens(F.col("text"))).filter(F.size("_tokens") > 0)
    return distinct_texts(with_tokens, keys, "_tokens", order)


def repeat_edge(threshold: float) -> Column:
    """Some earlier/later pair of the two texts reaches the threshold in that order."""
    return ((F.col("ab") >= threshold) & (F.col("a_first_at") < F.col("b_last_at"))) | (
        (F.col("ba") >= threshold) & (F.col("b_first_at") < F.col("a_last_at"))
    )


def repeat_pairs(
    utterances: DataFrame, keys: Sequence[str], order: str, threshold: float = REPEAT_SIMILARITY
) -> DataFrame:
    """Similar pairs of distinct texts with both scores; copies of one text stay collapsed
    into first and last position and a count."""
    pairs = similar_pairs(repeat_texts(utterances, keys, order), keys, threshold)
    return pairs.filter(repeat_edge(threshold))


def repeat_clusters(
    utterances: DataFrame, keys: Sequence[str], order: str, threshold: float = REPEAT_SIMILARITY
) -> DataFrame:
    """Utterances in clusters of repeats (connected by similarity), latest of each kept."""
    keys = list(keys)
    texts = repeat_texts(utterances, keys, order)
    labels = similar_components(texts, keys, threshold, repeat_edge(threshold))
    spoken = utterances.withColumn("_tokens", tokens(F.col("text"))).filter(F.size("_tokens") > 0)
    spoken = spoken.withColumn("text_id", F.md5(F.array_join("_tokens", " "))).drop("_tokens")
    members = lookup_join(spoken, labels, [*keys, "text_id"], "inner").drop("text_id")
    return _latest_kept(members, [*keys, "component"], order)


def prefix_takes(
    utterances: DataFrame, keys: Sequence[str], order: str, covered: DataFrame | None = None, hook: str = HOOK
) -> DataFrame:
    """Uncovered utterances with the same hook phrase, two or more; the latest is kept."""
    rows = utterances if covered is None else utterances.join(covered.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")
    hooked = rows.withColumn("hook", take_prefix(F.col("text"), hook)).filter(F.col("hook").isNotNull())
    return _latest_kept(hooked, [*keys, "hook"], order)


def block_ids(utterances: DataFrame, layout: KeyLayout, order: Sequence[str], pause: float = BLOCK_PAUSE_S) -> DataFrame:
    """Blocks separated by pauses of at least ``pause``."""
    gap = F.bround(F.col("start_s") - F.col("_end"), 6)
    return islands(utterances, layout, order, gap >= pause, prev={"_end": "end_s"}, out="block").drop("_end")


def block_repeats(
    blocks: DataFrame, layout: KeyLayout, order: Sequence[str], threshold: float = REPEAT_SIMILARITY
) -> DataFrame:
    """(keys, left_block, right_block): of each block the next one whose first three utterances sound
    alike; the earlier block is the cut.

    Equal heads follow one another in the order of their text. For two similar texts the blocks of
    both stand in one order, and each left one looks ahead to the nearest right one. So blocks are
    listed once per similar text and never paired.
    """
    keys = list(layout.keys)
    inside = KeyLayout((*layout.keys, "block"), layout.order)
    heads = ordered_scan(blocks, inside, order, number="_n").filter("_n <= 3")
    texts = heads.groupBy(*keys, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda r: r["text"]), " ").alias("text")
    )
    spoken = texts.withColumn("_tokens", tokens(F.col("text"))).filter(F.size("_tokens") > 0)
    spoken = cut_lineage(spoken.select(*keys, "block", "_tokens", F.md5(F.array_join("_tokens", " ")).alias("text_id")))
    places = spoken.select(*keys, "block", "text_id")
    by_text = [*keys, "text_id"]
    equal = ordered_scan(places, KeyLayout.measure(places, by_text, "block"), ["block"], nxt={"_right": "block"})
    found = equal.filter("_right IS NOT NULL").select(*keys, F.col("block").alias("_left"), "_right")

    pairs = similar_pairs(distinct_texts(spoken, keys, "_tokens", "block"), keys, threshold)
    way = lambda a, b, score: pairs.filter(F.col(score) >= threshold).select(*keys, F.col(a).alias("_l"), F.col(b).alias("_r"))
    directed = cut_lineage(way("a_id", "b_id", "ab").unionByName(way("b_id", "a_id", "ba")))
    listed = [
        directed.withColumn("text_id", F.col(side)).join(places, by_text).select(*keys, "_l", "_r", "block", F.lit(right).alias("_is_right"))
        for side, right in (("_l", False), ("_r", True))
    ]
    both = cut_lineage(listed[0].unionByName(listed[1]))
    ahead = ordered_scan(both, KeyLayout.measure(both, [*keys, "_l", "_r"], "block"), ["block"], coming={"_right": F.when(F.col("_is_right"), F.col("block"))})
    similar = ahead.filter("NOT _is_right AND _right IS NOT NULL").select(*keys, F.col("block").alias("_left"), "_right")
    return found.unionByName(similar).groupBy(*keys, F.col("_left").alias("left_block")).agg(F.min("_right").alias("right_block"))


def accepted_blocks(takes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Block takes that stand, in the order of their left blocks; ``takes`` has left_block, right_block, taken.

    A take falls when its left block is taken already: by ``taken``, or as the right block of a take
    that stands. Only a recording's blocks with a repeat are folded.
    """
    row = F.struct("left_block", "right_block", "taken")
    listed = takes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_takes"))
    none = F.array().cast("array<bigint>")

    def step(rights: Column, take: Column) -> Column:
        falls = take["taken"] | F.array_contains(rights, take["left_block"])
        return F.when(falls, rights).otherwise(F.array_append(rights, take["right_block"]))

    rights = F.aggregate("_takes", none, step)
    stands = lambda t: ~t["taken"] & ~F.array_contains(F.col("_rights"), t["left_block"])
    return listed.withColumn("_rights", rights).select(*keys, F.explode(F.filter("_takes", stands)).alias("_t")).select(*keys, "_t.left_block", "_t.right_block")


def take_chain(
    utterances: DataFrame, layout: KeyLayout, order: Sequence[str], group: str, threshold: float = REPEAT_SIMILARITY,
    pause: float = BLOCK_PAUSE_S, hook: str = HOOK,
) -> DataFrame:
    """All takes of a recording by four producers, each on what those before it left uncovered.

    Rows (keys, priority, reason, take, id, role), where role is cut, keep or, inside a kept block,
    member. 1: named groups. 2: clusters of repeats with a member not covered yet. 3: blocks like a
    later block, unless one of their utterances is covered. 4: uncovered utterances with one hook.
    Ids are unique in a recording; ``order`` starts with a column of distinct values.
    """
    keys, at = list(layout.keys), order[0]
    by_id = [*keys, "id"]
    role = F.when(F.col("kept"), F.lit("keep")).otherwise(F.lit("cut")).alias("role")

    def rows(df: DataFrame, priority: int, take: Column) -> DataFrame:
        return cut_lineage(df.select(*keys, F.lit(priority).alias("priority"), F.lit(TAKE_REASONS[priority - 1]).alias("reason"), take.alias("take"), "id", role))

    def without(df: DataFrame, covered: DataFrame) -> DataFrame:
        return df.join(covered.select(*by_id).distinct().withColumn("_covered", F.lit(True)), by_id, "left").withColumn("_covered", F.coalesce("_covered", F.lit(False)))

    spoken = cut_lineage(utterances.select(*keys, "id", *[c for c in dict.fromkeys([*order, "end_s", "text"]) if c != "id"], F.col(group).alias("_group")))
    named = rows(explicit_takes(spoken, keys, "_group", at), 1, F.col("_group"))

    clusters = repeat_clusters(spoken, keys, at, threshold)
    open_ = without(clusters, named).groupBy(*keys, "component").agg(F.bool_and("_covered").alias("_all"), F.min_by("id", at).alias("_first"), F.max_by("id", at).alias("_last"))
    chosen = lookup_join(clusters, open_.filter("NOT _all"), [*keys, "component"], "inner")
    repeats = rows(chosen, 2, F.concat_ws("-", "_first", "_last"))
    covered = named.unionByName(repeats)

    blocks = cut_lineage(block_ids(spoken, layout, order, pause))
    touched = without(blocks, covered).groupBy(*keys, "block").agg(
        F.bool_or("_covered").alias("taken"), F.min_by("id", at).alias("_first"), F.max_by("id", at).alias("_last")
    )
    touched = cut_lineage(touched)
    takes = block_repeats(blocks, layout, order, threshold).join(touched.select(*keys, F.col("block").alias("left_block"), "taken"), [*keys, "left_block"])
    stand = cut_lineage(accepted_blocks(takes, keys))
    name = lambda side: touched.select(*keys, F.col("block").alias(f"{side}_block"), F.col("_first").alias(f"_{side}"), F.col("_last").alias(f"_{side}_last"))
    stand = stand.join(name("left"), [*keys, "left_block"]).join(name("right"), [*keys, "right_block"])
    take, place = F.concat_ws("-", "_left", "_right").alias("take"), blocks.select(*keys, "block", "id")
    cut = stand.select(*keys, F.col("left_block").alias("block"), take, F.lit(None).cast("string").alias("_keep")).join(place, [*keys, "block"])
    kept = stand.select(*keys, F.col("right_block").alias("block"), take, F.col("_right_last").alias("_keep")).join(place, [*keys, "block"])
    how = F.when(F.col("_keep").isNull(), F.lit("cut")).when(F.col("_keep") == F.col("id"), F.lit("keep")).otherwise(F.lit("member"))
    both = cut.unionByName(kept).select(*keys, F.lit(3).alias("priority"), F.lit(TAKE_REASONS[2]).alias("reason"), "take", "id", how.alias("role"))
    both = cut_lineage(both)
    covered = covered.unionByName(both)

    hooked = prefix_takes(spoken, keys, at, covered, hook)
    ends = hooked.groupBy(*keys, "hook").agg(F.min_by("id", at).alias("_first"), F.max_by("id", at).alias("_last"))
    prefixes = rows(lookup_join(hooked, ends, [*keys, "hook"], "inner"), 4, F.concat_ws("-", "_first", "_last"))
    return covered.unionByName(prefixes)


def take_proposals(takes: DataFrame, repeated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, priority, proposal) for ``proposed_cuts``: what takes cut, then utterances repeated later.

    ``repeated`` has the ids of utterances with a later repeat.
    """
    said = F.element_at(F.array(*[F.lit(p) for p in TAKE_PROPOSALS]), F.col("priority"))
    cuts = takes.filter("role = 'cut'").select(*keys, "id", "priority", said.alias("proposal"))
    return cuts.unionByName(repeated.select(*keys, "id", F.lit(len(TAKE_PROPOSALS) + 1).alias("priority"), F.lit(TAKE_PROPOSALS[1]).alias("proposal")))


def repeated_later(utterances: DataFrame, keys: Sequence[str], order: str, threshold: float = REPEAT_SIMILARITY) -> DataFrame:
    """(keys, id) of utterances that a later utterance of the recording repeats."""
    keys = list(keys)
    texts = repeat_texts(utterances, keys, order)
    latest = later_matches(repeat_pairs(utterances, keys, order, threshold), texts, keys, threshold)
    spoken = utterances.withColumn("_tokens", tokens(F.col("text"))).filter(F.size("_tokens") > 0)
    spoken = spoken.select(*keys, "id", F.col(order).alias("_at"), F.md5(F.array_join("_tokens", " ")).alias("text_id"))
    return lookup_join(spoken, latest, [*keys, "text_id"], "inner").filter("latest_repeat > _at").select(*keys, "id")


def analysis_verdict(recordings: DataFrame, candidates: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, candidates, verdict) of each recording; ``candidates`` are tables with one row per candidate."""
    keys = list(keys)
    every = reduce(DataFrame.unionByName, [c.select(*keys) for c in candidates])
    counted = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"))
    out = recordings.select(*keys).distinct().join(counted, keys, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    return out.withColumn("verdict", F.when(F.col("candidates") > 0, F.lit("CANDIDATES_PROPOSED")).otherwise(F.lit("NO_CANDIDATES")))


def candidate_union(pauses: DataFrame, repeats: DataFrame, takes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All candidates as (key, id, kind), each for review."""
    parts = [
        table.select(*keys, F.col("candidate_id"), F.lit(kind).alias("kind"))
        for table, kind in ((pauses, "pause"), (repeats, "repetition"), (takes, "take"))
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("decision", F.lit("REVIEW"))


def proposed_cuts(entries: DataFrame, proposals: DataFrame, keys: Sequence[str], marker: str = MARKER) -> DataFrame:
    """Entry kinds after proposals: a source cut stays, then a marker, then the first proposal.

    ``proposals``: key, id, priority, proposal.
    """
    first = proposals.groupBy(*keys, "id").agg(F.min_by("proposal", "priority").alias("_proposal"))
    joined = entries.join(first, [*keys, "id"], "left")
    reason = (
        F.when(F.col("kind") == "cut", F.col("reason"))
        .when(retake_marker(F.col("text"), marker), F.lit("retake-marker"))
        .otherwise(F.col("_proposal"))
    )
    kind = F.when((F.col("kind") == "cut") | reason.isNotNull(), F.lit("cut")).otherwise(F.lit("keep"))
    return joined.withColumn("_reason", reason).withColumn("_kind", kind).drop("_proposal", "kind", "reason").withColumnsRenamed(
        {"_reason": "reason", "_kind": "kind"}
    )


def later_matches(pairs: DataFrame, texts: DataFrame, keys: Sequence[str], threshold: float = REPEAT_SIMILARITY) -> DataFrame:
    """Per text the latest position of a text that repeats it (itself when it has copies)."""
    keys = list(keys)
    own = texts.filter("copies > 1").select(*keys, "text_id", F.col("last_at").alias("_later"))
    ahead = pairs.filter(F.col("ab") >= threshold).select(*keys, F.col("a_id").alias("text_id"), F.col("b_last_at").alias("_later"))
    behind = pairs.filter(F.col("ba") >= threshold).select(*keys, F.col("b_id").alias("text_id"), F.col("a_last_at").alias("_later"))
    both = own.unionByName(ahead).unionByName(behind)
    return both.groupBy(*keys, "text_id").agg(F.max("_later").alias("latest_repeat"))
