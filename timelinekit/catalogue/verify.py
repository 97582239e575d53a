"""Transcript verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelinekit.catalogue.editorial import TOKENS_SQL
from timelinekit.catalogue.standins import SERIES, UTTERANCES, WORDS, series, table, utterances, words
from timelinekit.functions import text as tx
from timelinekit.operators import verify as vf

QUERIES, SQL = {}, {}


def _q(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Event types of a user and day, in time order, are the planned words; the rendered ones miss some.
def _sides(spark, sf):
    """Both sides per user and day, so that no list grows with a busy user."""
    heard = F.when(F.col("id") % 9 == 0, F.lit("x")).otherwise(F.left("event_type", F.lit(1)))
    rows = series(spark, sf).withColumn("day", F.floor(F.col("t") / 86400)).withColumn("heard", heard)
    listed = rows.groupBy("k", "day").agg(F.array_sort(F.collect_list(F.struct("t", "id", "event_type", "heard"))).alias("_e"))
    return listed.select(
        "k", "day", F.transform("_e", lambda r: F.left(r["event_type"], F.lit(1))).alias("expected"),
        F.transform(F.filter("_e", lambda r: r["id"] % 7 != 0), lambda r: r["heard"]).alias("actual"),
    )


_DAY_SIDES = f"""(SELECT k, CAST(floor(t / 86400) AS BIGINT) AS day, string_agg(left(event_type, 1), '' ORDER BY t, id) AS e,
  coalesce(string_agg(CASE WHEN id % 9 = 0 THEN 'x' ELSE left(event_type, 1) END, '' ORDER BY t, id) FILTER (id % 7 <> 0), '') AS a FROM {SERIES} s GROUP BY ALL)"""


@_q("wer_metrics", f"""SELECT k, day, CASE WHEN a = '' THEN length(e) ELSE levenshtein(e, a) END AS edit_distance,
  CASE WHEN a <> '' THEN round_even(levenshtein(e, a) / length(e), 6) END AS wer, a = '' AS empty FROM {_DAY_SIDES} d""")
def _(spark, sf):
    return vf.wer_metrics(_sides(spark, sf)).select("k", "day", "edit_distance", "wer", "empty")


@_q("levenshtein_tokens", f"SELECT k, day, CASE WHEN a = '' THEN length(e) ELSE levenshtein(e, a) END AS edit_distance FROM {_DAY_SIDES} d")
def _(spark, sf):
    out = _sides(spark, sf)
    return out.select("k", "day", vf.levenshtein_tokens(F.col("expected"), F.col("actual")).alias("edit_distance"))


@_q("normalize_tokens")
def _(spark, sf):
    return utterances(spark, sf).select("k", "id", F.array_join(tx.normalize_tokens(F.col("text")), " ").alias("tokens"))


_TOKEN_ROWS = f"""(SELECT k, id, unnest(ts) AS token, CAST(unnest(range(len(ts))) AS INT) AS i FROM (
  SELECT k, id, {TOKENS_SQL.format('text')} AS ts FROM {UTTERANCES} u))"""


@_q("ngram_echoes", f"""SELECT k, id, at_token FROM (SELECT k, id, unnest(list_transform(kept, lambda x: x - 1)) AS at_token FROM (
  SELECT k, id, list_reduce(list_transform(hits, lambda x: [x]), lambda acc, x: CASE WHEN x[1] >= acc[-1] + 2 THEN acc || x ELSE acc END) AS kept FROM (
    SELECT k, id, list_filter(range(1, greatest(len(ts) - 2, 1)), lambda i: ts[i] = ts[i + 2] AND ts[i + 1] = ts[i + 3] AND length(ts[i]) + 1 + length(ts[i + 1]) >= 4) AS hits
    FROM (SELECT k, id, {TOKENS_SQL.format('text')} AS ts FROM {UTTERANCES} u)) WHERE len(hits) > 0))""")
def _(spark, sf):
    echoes = vf.ngram_echoes(tx.tokens(F.col("text")), 2, 4)
    hits = utterances(spark, sf).select("k", "id", F.explode(echoes).alias("at_token"))
    return hits.withColumn("at_token", F.col("at_token").cast("long"))


@_q("repeated_openers", f"""WITH t AS (SELECT *, lead(token) OVER (PARTITION BY k, id ORDER BY i) AS nt, lag(token) OVER (PARTITION BY k, id ORDER BY i) AS pt FROM {_TOKEN_ROWS} r),
o AS (SELECT k, id, i, CASE WHEN pt = 'of' AND token = 'the' THEN NULL WHEN token = 'of' AND nt = 'the' THEN 'of the' WHEN token IN ('the', 'le', 'de') THEN token END AS opener FROM t)
SELECT k, id, opener, p AS at_token, i AS again_at, i - p AS gap_tokens FROM (
  SELECT *, lag(i) OVER (PARTITION BY k, id, opener ORDER BY i) AS p FROM o WHERE opener IS NOT NULL) WHERE i - p <= 6""")
def _(spark, sf):
    spoken = utterances(spark, sf).select("k", "id", F.posexplode(tx.tokens(F.col("text"))).alias("i", "token"))
    return vf.repeated_openers(spoken, ["k", "id"], "i", "token", ("the", "le", "de"), (("of", "the"),))


def _timed_pairs(spark, sf):
    """A document as planned, in clips of forty words, and as heard: some words lost, later ones
    late by a rule, a long silence in every fifth document, a late first word in every sixth."""
    dealt = table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    docs = dealt.select(F.col("doc_id").alias("k"), tx.tokens(F.col("text")).alias("expected"))
    places = F.sequence(F.lit(0), F.size("expected") - 1)
    kept = F.filter(places, lambda i: (i * 31 + F.col("k") * 17) % 23 != 0)
    usable = docs.filter(F.size("expected") > 0).withColumn("_kept", kept)
    clips = F.sequence(F.lit(0), F.size("expected") - 1, F.lit(40))
    early = F.when(F.col("k") % 6 == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    heard = F.transform("_kept", lambda i: i * 0.4 + (F.col("k") % 4) * 0.3 + F.when((F.col("k") % 5 == 0) & (i >= 20), F.lit(2.0)).otherwise(F.lit(0.0)))
    return usable.select(
        "k", "expected", F.transform(places, lambda i: i * 0.4).alias("expected_at"),
        F.transform("_kept", lambda i: F.element_at("expected", (i + 1).cast("int"))).alias("actual"), heard.alias("actual_at"),
        F.transform(heard, lambda at: at + 0.3).alias("actual_end"),
        F.transform(clips, lambda i: i * 0.4 - early).alias("clip_from"), F.transform(clips, lambda i: (i + 40) * 0.4 - early).alias("clip_to"),
    )


@_q("timing_drift")
def _(spark, sf):
    out = vf.timing_drift(_timed_pairs(spark, sf), "expected", "expected_at", "actual", "actual_at")
    return out.select("k", "compared", "over_threshold", "drift_ratio", "max_drift_s", "median_drift_s")


@_q("verify_transcripts")
def _(spark, sf):
    """Every document against its rendered twin: all measures, reasons and the verdict."""
    out = vf.verify_transcripts(_timed_pairs(spark, sf))
    return out.select(
        "k", "wer", "order_ratio", "edit_distance", "compared", "over_threshold", "drift_ratio", "max_drift_s", "median_drift_s", "long_gaps",
        "echoes", "openers_expected", "openers_actual", "lead_ins", F.array_join("reasons", "; ").alias("reasons"), "verdict",
    )


@_q("verdict_rollup", f"""SELECT k, CASE WHEN bool_and(value < 30) THEN 'PASS' ELSE 'FAIL' END AS verdict,
  coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (value >= 30)), '; '), '') AS reasons FROM {SERIES} s GROUP BY k""")
def _(spark, sf):
    failed = F.col("value") >= 30
    parts = series(spark, sf).select(
        "k", F.when(failed, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("v"), F.when(failed, F.array("event_type")).alias("r")
    )
    return vf.verdict_rollup(parts, ["k"], "v", "r")


@_q("word_tokens", f"SELECT k, pos, coalesce({TOKENS_SQL.format('text')}[1], '') AS token FROM {WORDS} w")
def _(spark, sf):
    return words(spark, sf).select("k", "pos", F.coalesce(F.try_element_at(tx.tokens(F.col("text")), F.lit(1)), F.lit("")).alias("token"))
