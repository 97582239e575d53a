"""Comparison of an expected with an actual transcript, and the faults found in it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.functions.arrow import matched_drifts, token_comparison, transcript_comparison
from timelinekit.functions.text import bound

# ---- fixed values -------------------------------------------------------------------------
WER_MAX, ORDER_MIN = 0.12, 0.9
DRIFT_S, DRIFT_RATIO, DRIFT_MIN_WORDS = 0.85, 0.25, 12
ECHO_WORDS, ECHO_MIN_CHARS = 2, 8
OPENERS = ("вместо",)
OPENER_PAIRS = (("то", "есть"),)
OPENER_GAP = 6
LONG_PAUSE_S, LEAD_IN_S = 1.2, 0.8
REASONS = {
    "empty": "expected or actual transcript is empty",
    "wer": "word error rate exceeds threshold",
    "order": "ordered token coverage below threshold",
    "gap": "unexpected long silence",
    "echo": "adjacent phrase echo in expected keep",
    "opener_expected": "repeated clause opener retake in expected keep",
    "opener_actual": "repeated clause opener retake in rendered speech",
    "lead_in": "leading silence inside keep clip",
    "drift": "speech timing drift exceeds threshold",
}
# -------------------------------------------------------------------------------------------


def _rates(measured: DataFrame, expected: str, actual: str) -> DataFrame:
    """wer, order_ratio and empty from edit_distance and lcs; the rates of an empty side are null."""
    n = F.size(expected)
    empty = (n <= 0) | (F.size(actual) <= 0)
    rate = lambda c: F.when(~empty, F.bround(F.col(c) / n, 6))
    return measured.withColumns({"wer": rate("edit_distance"), "order_ratio": rate("lcs"), "empty": empty})


def wer_metrics(pairs: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Token arrays of both sides to error rate, order ratio, edit distance and common length (one
    row per transcript; the two dynamic programs run bit-parallel in one Arrow UDF)."""
    compared = pairs.withColumn("_c", token_comparison(F.col(expected), F.col(actual)))
    return _rates(compared.select(*pairs.columns, "_c.edit_distance", "_c.lcs"), expected, actual)


def levenshtein_tokens(left: Column, right: Column) -> Column:
    """Token edit distance from built-ins: each token becomes one code point local to the pair."""

    def spelled(side: Column, vocabulary: Column) -> Column:
        # From U+10000 on there are no surrogates; every code is one UTF-32 unit.
        codes = F.transform(side, lambda t: F.lpad(F.hex(F.array_position(vocabulary, t) + 65536), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    vocabulary = F.array_distinct(F.concat(left, right))
    return bound(vocabulary, lambda v: F.levenshtein(spelled(left, v), spelled(right, v)))


def ngram_echoes(tokens: Column, n: int = ECHO_WORDS, min_chars: int = ECHO_MIN_CHARS) -> Column:
    """Places (from 0) where an n-gram is repeated at once; a hit moves on by ``n`` tokens."""

    def places(words: Column) -> Column:
        starts = F.when(F.size(words) >= 2 * n, F.sequence(F.lit(1), F.size(words) - 2 * n + 1))

        def repeats(at: Column) -> Column:
            gram = F.slice(words, at, F.lit(n))
            return (gram == F.slice(words, at + n, F.lit(n))) & (F.length(F.array_join(gram, " ")) >= min_chars)

        chosen = F.aggregate(
            F.filter(starts, repeats), F.array().cast("array<int>"),
            lambda acc, at: F.when((F.size(acc) == 0) | (at >= F.element_at(acc, -1) + n), F.array_append(acc, at)).otherwise(acc),
        )
        return F.coalesce(F.transform(chosen, lambda at: at - 1), F.array().cast("array<int>"))

    return bound(tokens, places)


def repeated_openers(
    words: DataFrame, keys: Sequence[str], index: str, token: str, openers: Sequence[str] = OPENERS,
    pairs: Sequence[tuple[str, str]] = OPENER_PAIRS, max_gap: int = OPENER_GAP,
) -> DataFrame:
    """The same opener again within ``max_gap`` tokens; a pair counts as one opener of two tokens.

    ``keys`` identify one transcript, whose words come from one row of the source.
    """
    ordered = Window.partitionBy(*keys).orderBy(index)
    following = F.lead(token).over(ordered)
    key = F.when(F.col(token).isin(*openers), F.col(token))
    for first, second in pairs:
        key = F.when((F.col(token) == first) & (F.col("_next") == second), F.lit(f"{first} {second}")).otherwise(key)
    if {a for a, _ in pairs} & {b for _, b in pairs}:
        raise ValueError("the second word of a pair must not begin a pair")
    # the second word of a pair belongs to the pair and opens nothing itself
    inside = F.lit(False)
    for first, second in pairs:
        inside = inside | ((F.col("_last") == first) & (F.col(token) == second))
    key = F.when(~F.coalesce(inside, F.lit(False)), key)
    found = words.withColumn("_next", following).withColumn("_last", F.lag(token).over(ordered)).withColumn("opener", key).filter(F.col("opener").isNotNull())
    before = F.lag(index).over(Window.partitionBy(*keys, "opener").orderBy(index))
    hits = found.withColumn("at_token", before).withColumn("gap_tokens", F.col(index) - F.col("at_token"))
    return hits.filter(F.col("gap_tokens") <= max_gap).select(
        *keys, "opener", "at_token", F.col(index).alias("again_at"), "gap_tokens"
    )


def opener_repeats(
    tokens: Column, openers: Sequence[str] = OPENERS, pairs: Sequence[tuple[str, str]] = OPENER_PAIRS, max_gap: int = OPENER_GAP
) -> Column:
    """How often an opener comes again within ``max_gap`` tokens of an array; the rule of ``repeated_openers``."""

    def hits(words: Column) -> Column:
        every = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        yes = lambda c: F.coalesce(c, F.lit(False))

        def stands(pair: tuple[str, str], at: Column) -> Column:
            return yes((F.get(words, at) == pair[0]) & (F.get(words, at + 1) == pair[1]))

        def in_pair(at: Column) -> Column:
            return reduce(or_, [stands(p, at) | stands(p, at - 1) for p in pairs], F.lit(False))

        def again(found: Column) -> Column:
            return F.size(F.filter(found, lambda s, n: yes(s["i"] - F.get(found, n - 1)["i"] <= max_gap)))

        def of_pair(pair: tuple[str, str]) -> Column:
            return F.filter(every, lambda s: stands(pair, s["i"]))

        def of_word(word: str) -> Column:
            return F.filter(every, lambda s: (s["w"] == word) & ~in_pair(s["i"]))

        return reduce(add, [again(x) for x in [*map(of_pair, pairs), *map(of_word, openers)]], F.lit(0))

    return bound(tokens, hits)


def long_pauses(starts: Column, ends: Column, limit: float = LONG_PAUSE_S) -> Column:
    """How many words begin more than ``limit`` after the end of the word before."""
    late = F.filter(starts, lambda s, i: F.coalesce(s - F.get(ends, i - 1) > limit, F.lit(False)))
    return F.size(late)


def _drift_columns(found: DataFrame, drifts: str, limit: float) -> DataFrame:
    n = F.size(drifts)
    over = F.size(F.filter(drifts, lambda x: x > limit))
    known = lambda value: F.when(n > 0, value).otherwise(F.lit(0.0))
    return found.withColumns({
        "compared": n, "over_threshold": over, "drift_ratio": known(F.bround(over / n, 4)),
        "max_drift_s": known(F.bround(F.element_at(drifts, -1), 3)),
        "median_drift_s": known(F.bround(F.element_at(drifts, (F.floor(n / 2) + 1).cast("int")), 3)),
    }).drop(drifts)


def timing_drift(
    pairs: DataFrame, expected: str, expected_at: str, actual: str, actual_at: str, limit: float = DRIFT_S
) -> DataFrame:
    """Greedy forward match of equal words, then the spread of their start differences."""
    found = pairs.withColumn("_d", F.array_sort(matched_drifts(F.col(expected), F.col(expected_at), F.col(actual), F.col(actual_at))))
    return _drift_columns(found, "_d", limit)


def verify_transcripts(
    pairs: DataFrame, max_silence_s: float = LONG_PAUSE_S, max_drift_s: float = DRIFT_S, max_lead_s: float = LEAD_IN_S
) -> DataFrame:
    """The whole check of rendered speech against its plan: every measure, the reasons and the verdict.

    ``pairs`` has a row per transcript with arrays: expected, expected_at (planned words and their
    starts), clip_from, clip_to (the planned clips), actual, actual_at, actual_end (heard words).
    All comparisons of two arrays run in one Arrow call.
    """
    compare = transcript_comparison(max_lead_s)
    arrays = [F.col(c) for c in ("expected", "expected_at", "actual", "actual_at", "clip_from", "clip_to")]
    measured = pairs.withColumn("_c", compare(*arrays))
    measured = measured.select(*pairs.columns, "_c.edit_distance", "_c.lcs", "_c.lead_ins", F.array_sort("_c.drifts").alias("_d"))
    measured = _rates(_drift_columns(measured, "_d", max_drift_s), "expected", "actual").withColumns({
        "long_gaps": long_pauses(F.col("actual_at"), F.col("actual_end"), max_silence_s),
        "echoes": F.size(ngram_echoes(F.col("expected"))),
        "openers_expected": opener_repeats(F.col("expected")), "openers_actual": opener_repeats(F.col("actual")),
    })
    rules = [F.col(c) for c in ("wer", "order_ratio", "empty", "long_gaps", "echoes", "openers_expected", "openers_actual", "lead_ins", "compared", "drift_ratio")]
    judged = measured.withColumn("reasons", transcript_reasons(*rules))
    return judged.withColumn("verdict", F.when(F.size("reasons") > 0, F.lit("FAIL")).otherwise(F.lit("PASS")))


def transcript_reasons(
    wer: Column, order_ratio: Column, empty: Column, long_gaps: Column, echoes: Column, openers_expected: Column,
    openers_actual: Column, lead_ins: Column, compared: Column, drift_ratio: Column,
) -> Column:
    """Reasons a transcript fails, in order; counts are numbers of hits."""
    opener = F.when(openers_expected > 0, F.lit(REASONS["opener_expected"])).when(openers_actual > 0, F.lit(REASONS["opener_actual"]))
    reasons = F.array_compact(F.array(
        F.when(wer > WER_MAX, F.lit(REASONS["wer"])),
        F.when(order_ratio < ORDER_MIN, F.lit(REASONS["order"])),
        F.when(long_gaps > 0, F.lit(REASONS["gap"])),
        F.when(echoes > 0, F.lit(REASONS["echo"])),
        opener,
        F.when(lead_ins > 0, F.lit(REASONS["lead_in"])),
        F.when((compared >= DRIFT_MIN_WORDS) & (drift_ratio > DRIFT_RATIO), F.lit(REASONS["drift"])),
    ))
    return F.when(empty, F.array(F.lit(REASONS["empty"]))).otherwise(reasons)


def verdict_rollup(components: DataFrame, keys: Sequence[str], verdict: str, reasons: str) -> DataFrame:
    """PASS only when all components pass; distinct reasons are listed in name order.

    Reasons come from a fixed rule list, so the collected set stays small.
    """
    each = components.select(*keys, F.col(verdict).alias("_v"), F.explode_outer(reasons).alias("_reason"))
    out = each.groupBy(*keys).agg(F.bool_and(F.col("_v") == "PASS").alias("_ok"), F.collect_set("_reason").alias("_reasons"))
    return out.select(
        *keys, F.when(F.col("_ok"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"),
        F.array_join(F.array_sort("_reasons"), "; ").alias("reasons"),
    )
