"""Editorial queries: a document is a recording, its lines are utterances."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelinekit.catalogue.standins import UTTERANCES, utterances
from timelinekit.functions import text as tx
from timelinekit.operators import cross as cr
from timelinekit.operators import editorial as ed
from timelinekit.operators import pauses as pz
from timelinekit.plans.layout import KeyLayout

QUERIES, SQL = {}, {}
PER_DOCUMENT = KeyLayout(("k",), "start_s")
ORDER = ["start_s", "id"]

# Patterns that occur in the given texts stand in for the fixed phrases of the operators.
HOOK = r"(?iU)(?:the\s|le\s|en\s)"
MARKER = r"(?iU)(?:nicht|tion\.)"
HOOK_SQL = r"(?i)^(?:(?:the\s|le\s|en\s))"
MARKER_SQL = r"(?i)(?:nicht|tion\.)"
STARTS = r"the\s|le\s|en\s"


def _q(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


TOKENS_SQL = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_'']+')"
_DECIDED = f"(SELECT *, CASE WHEN (k + pos) % 6 = 0 THEN 'cut' ELSE 'keep' END AS decision FROM {UTTERANCES} u)"
_REASONED = f"""(SELECT *, decision AS kind, CASE WHEN decision = 'cut' THEN CASE WHEN pos % 2 = 0 THEN 'proposed-take' ELSE 'false-start' END END AS reason
  FROM {_DECIDED} d)"""


def decided(spark, sf):
    return utterances(spark, sf).withColumn("decision", F.expr("CASE WHEN (k + pos) % 6 = 0 THEN 'cut' ELSE 'keep' END"))


def reasoned(spark, sf):
    reason = F.expr("CASE WHEN decision = 'cut' THEN CASE WHEN pos % 2 = 0 THEN 'proposed-take' ELSE 'false-start' END END")
    return decided(spark, sf).withColumn("kind", F.col("decision")).withColumn("reason", reason)


@_q("retake_marker", f"SELECT k, id, regexp_matches(text, '{MARKER_SQL}') AS marker, regexp_matches(text, '{HOOK_SQL}') AS hook FROM {UTTERANCES} u")
def _(spark, sf):
    return utterances(spark, sf).select(
        "k", "id", ed.retake_marker(F.col("text"), MARKER).alias("marker"),
        F.col("text").rlike(f"^(?:{HOOK})").alias("hook"),
    )


@_q("false_cohesion", rf"""SELECT k, id, hooks, hooks >= 2 OR (regexp_matches(text, '{MARKER_SQL}') AND hooks >= 1) AS false_cohesion FROM (
  SELECT k, id, text, CAST(len(regexp_extract_all(text, '(?i)^(?:{STARTS})')) + len(regexp_extract_all(text, '(?i)[.!?…]\s(?:{STARTS})')) AS INT) AS hooks
  FROM {UTTERANCES} u)""")
def _(spark, sf):
    return utterances(spark, sf).select(
        "k", "id", ed.hook_start_count(F.col("text"), STARTS).alias("hooks"),
        ed.false_cohesion(F.col("text"), STARTS, MARKER).alias("false_cohesion"),
    )


@_q("mid_clause", f"""SELECT k, id, regexp_matches(left(text, 1), '^\\p{{Ll}}$') OR left(text, 1) IN ('«', '"', '''', '(') AS mid_clause FROM {UTTERANCES} u""")
def _(spark, sf):
    return utterances(spark, sf).select("k", "id", ed.mid_clause(F.col("text")).alias("mid_clause"))


@_q("merge_fragments", f"""WITH f AS (SELECT *, sum(CASE WHEN len({TOKENS_SQL.format("text")}) <= 8 AND start_s - pe <= 3.0
      AND NOT regexp_matches(text, '{HOOK_SQL}') AND decision = pd THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY start_s, id) AS run
  FROM (SELECT *, lag(end_s) OVER w AS pe, lag(decision) OVER w AS pd FROM {_DECIDED} d WINDOW w AS (PARTITION BY k ORDER BY start_s, id)))
SELECT k, arg_min(id, start_s) AS id, min(start_s) AS start_s, arg_max(end_s, start_s) AS end_s, string_agg(text, ' ' ORDER BY start_s, id) AS text,
  arg_min(decision, start_s) AS decision, count(*) AS parts FROM f GROUP BY k, run""")
def _(spark, sf):
    return ed.merge_fragments(decided(spark, sf), PER_DOCUMENT, ORDER, 8, 3.0, HOOK)


@_q("merge_incomplete")
def _(spark, sf):
    return ed.merge_incomplete(decided(spark, sf), PER_DOCUMENT, ORDER, 3.0, MARKER, HOOK)


@_q("merge_take_blocks", f"""WITH s AS (SELECT *, regexp_matches(text, '{HOOK_SQL}') AS opens,
    last_value(CASE WHEN regexp_matches(text, '{MARKER_SQL}') THEN 0 WHEN regexp_matches(text, '{HOOK_SQL}') THEN 1 END IGNORE NULLS)
      OVER (PARTITION BY k ORDER BY start_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_DECIDED} d),
f AS (SELECT *, sum(CASE WHEN opens OR coalesce(before, 0) <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_s, id) AS run FROM s)
SELECT k, arg_min(id, start_s) AS id, min(start_s) AS start_s, arg_max(end_s, start_s) AS end_s, string_agg(text, ' ' ORDER BY start_s, id) AS text,
  arg_min(decision, start_s) AS decision, count(*) AS parts FROM f GROUP BY k, run""")
def _(spark, sf):
    return ed.merge_take_blocks(decided(spark, sf), PER_DOCUMENT, ORDER, MARKER, HOOK)


@_q("absorb_tails", f"""WITH e AS (SELECT *, kind = 'keep' AND pos % 5 <> 0 AND (regexp_matches(left(text, 1), '^\\p{{Ll}}$') OR left(text, 1) IN ('«', '"', '''', '('))
    AND len({TOKENS_SQL.format("text")}) <= 8 AS loose, kind = 'cut' AND (starts_with(reason, 'proposed-') OR reason IN ('hanging-clause', 'retake-marker')) AS allows
  FROM {_REASONED} r),
b AS (SELECT *, loose AND coalesce(last_value(CASE WHEN NOT loose THEN allows END IGNORE NULLS) OVER (PARTITION BY k ORDER BY start_s, id), false) AS absorbed FROM e),
f AS (SELECT *, sum(CASE WHEN absorbed THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY start_s, id) AS run FROM b)
SELECT k, arg_min(id, start_s) AS id, arg_min(kind, start_s) AS kind, min(start_s) AS start_s, arg_max(end_s, start_s) AS end_s,
  arg_min_null(reason, start_s) AS reason, count(*) AS parts FROM f GROUP BY k, run""")
def _(spark, sf):
    return ed.absorb_tails(reasoned(spark, sf), PER_DOCUMENT, ORDER, F.col("pos") % 5 == 0)


_GROUPED = f"(SELECT *, CASE WHEN pos % 3 = 0 THEN 'g' || (length(text) % 4) END AS take_group FROM {UTTERANCES} u)"


@_q("explicit_takes", f"""SELECT k, take_group, id, members, start_s = latest AS kept FROM (
  SELECT *, count(*) OVER w AS members, max(start_s) OVER w AS latest FROM {_GROUPED} g WHERE take_group IS NOT NULL
  WINDOW w AS (PARTITION BY k, take_group)) WHERE members >= 2""")
def _(spark, sf):
    group = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("g"), (F.length("text") % 4).cast("string")))
    out = ed.explicit_takes(utterances(spark, sf).withColumn("take_group", group), ["k"], "take_group", "start_s")
    return out.select("k", "take_group", "id", "members", "kept")


@_q("prefix_takes", f"""SELECT k, hook, id, members, start_s = latest AS kept FROM (
  SELECT *, count(*) OVER w AS members, max(start_s) OVER w AS latest FROM (
    SELECT *, lower(regexp_extract(text, '(?i)(?:the\\s|le\\s|en\\s)')) AS hook FROM {UTTERANCES} u WHERE pos % 4 <> 0) WHERE hook <> ''
  WINDOW w AS (PARTITION BY k, hook)) WHERE members >= 2""")
def _(spark, sf):
    rows = utterances(spark, sf)
    out = ed.prefix_takes(rows, ["k"], "start_s", rows.filter("pos % 4 = 0"), HOOK)
    return out.select("k", "hook", "id", "members", "kept")


@_q("repeat_pairs")
def _(spark, sf):
    pairs = ed.repeat_pairs(utterances(spark, sf), ["k"], "pos")
    return pairs.select("k", "a_first_at", "b_first_at", F.bround("ab", 6).alias("ab"), F.bround("ba", 6).alias("ba"))


@_q("repeat_clusters")
def _(spark, sf):
    rows = utterances(spark, sf).select("k", "id", "start_s", "text")
    return ed.repeat_clusters(rows, ["k"], "start_s").select("k", "id", "component", "members", "kept")


@_q("repeat_clusters_by_source")
def _(spark, sf):
    """Whole sources as recordings: groups of copies across documents stay collapsed."""
    rows = utterances(spark, sf).select(
        F.col("source").alias("project"), F.concat_ws("-", "k", "id").alias("id"),
        (F.col("k") * 100_000 + F.col("pos")).alias("at"), "text",
    )
    return ed.repeat_clusters(rows, ["project"], "at").select("project", "id", "component", "members", "kept")


_BLOCKS = f"""(SELECT k, id, pos, start_s, text, CAST(sum(CASE WHEN pe IS NULL OR round(start_s - pe, 6) >= 3.5 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_s, id) AS BIGINT) AS block
  FROM (SELECT *, lag(end_s) OVER (PARTITION BY k ORDER BY start_s, id) AS pe FROM {UTTERANCES} u))"""


@_q("block_ids", f"SELECT k, id, block FROM {_BLOCKS} b")
def _(spark, sf):
    return ed.block_ids(utterances(spark, sf), PER_DOCUMENT, ORDER, 3.5).select("k", "id", "block")


@_q("block_repeats")
def _(spark, sf):
    blocks = ed.block_ids(utterances(spark, sf), PER_DOCUMENT, ORDER, 3.5)
    return ed.block_repeats(blocks, PER_DOCUMENT, ORDER)


@_q("candidate_union", f"""SELECT k, 'pause-' || id || '-' || nid AS candidate_id, 'pause' AS kind, 'REVIEW' AS decision FROM (
    SELECT *, lead(id) OVER w AS nid, lead(start_s) OVER w AS ns FROM {UTTERANCES} u WINDOW w AS (PARTITION BY k ORDER BY start_s, id)) WHERE round(ns - end_s, 6) >= 0.8
  UNION ALL SELECT DISTINCT k, 'repetition-' || md5(text), 'repetition', 'REVIEW' FROM (SELECT k, text FROM {UTTERANCES} u GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT k, 'take-' || take_group, 'take', 'REVIEW' FROM {_GROUPED} g WHERE take_group IS NOT NULL GROUP BY k, take_group HAVING count(*) >= 2""")
def _(spark, sf):
    rows = utterances(spark, sf)
    pauses = pz.utterance_pauses(rows, PER_DOCUMENT, ORDER).select("k", F.col("pause_id").alias("candidate_id"))
    repeats = rows.groupBy("k", "text").count().filter("count > 1").select("k", F.concat(F.lit("repetition-"), F.md5("text")).alias("candidate_id"))
    group = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("g"), (F.length("text") % 4).cast("string")))
    takes = ed.explicit_takes(rows.withColumn("take_group", group), ["k"], "take_group", "start_s").select(
        "k", F.concat(F.lit("take-"), "take_group").alias("candidate_id")
    ).distinct()
    return ed.candidate_union(pauses, repeats, takes, ["k"])


@_q("proposed_cuts", f"""WITH t AS (SELECT k, id, 1 AS p, 'proposed-take' AS r FROM (
    SELECT *, count(*) OVER w AS n, max(start_s) OVER w AS latest FROM {_GROUPED} g WHERE take_group IS NOT NULL WINDOW w AS (PARTITION BY k, take_group))
    WHERE n >= 2 AND start_s < latest
  UNION ALL SELECT k, id, 4, 'proposed-retake-prefix' FROM (SELECT *, count(*) OVER w AS n, max(start_s) OVER w AS latest FROM (
      SELECT *, lower(regexp_extract(text, '(?i)(?:the\\s|le\\s|en\\s)')) AS hook FROM {UTTERANCES} u) WHERE hook <> '' WINDOW w AS (PARTITION BY k, hook)) WHERE n >= 2 AND start_s < latest),
f AS (SELECT k, id, arg_min(r, p) AS r FROM t GROUP BY k, id),
j AS (SELECT e.k, e.id, CASE WHEN e.kind = 'cut' THEN e.reason WHEN regexp_matches(e.text, '{MARKER_SQL}') THEN 'retake-marker' ELSE f.r END AS reason, e.kind AS was
  FROM {_REASONED} e LEFT JOIN f ON e.k = f.k AND e.id = f.id)
SELECT k, id, reason, CASE WHEN was = 'cut' OR reason IS NOT NULL THEN 'cut' ELSE 'keep' END AS kind FROM j""")
def _(spark, sf):
    rows = utterances(spark, sf)
    group = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("g"), (F.length("text") % 4).cast("string")))
    takes = ed.explicit_takes(rows.withColumn("take_group", group), ["k"], "take_group", "start_s")
    hooks = ed.prefix_takes(rows, ["k"], "start_s", None, HOOK)
    proposals = takes.filter("NOT kept").select("k", "id", F.lit(1).alias("priority"), F.lit("proposed-take").alias("proposal")).unionByName(
        hooks.filter("NOT kept").select("k", "id", F.lit(4).alias("priority"), F.lit("proposed-retake-prefix").alias("proposal"))
    )
    return ed.proposed_cuts(reasoned(spark, sf), proposals, ["k"], MARKER).select("k", "id", "reason", "kind")


# With a similarity of one, repeats are equal token lists, which SQL can state.
_CHAIN = f"""(WITH u AS (SELECT *, array_to_string({TOKENS_SQL.format('text')}, ' ') AS said, lower(regexp_extract(text, '(?i)(?:the\\s|le\\s|en\\s)')) AS hook FROM {_GROUPED} g),
x AS (SELECT k, 1 AS priority, take_group AS take, id, CASE WHEN start_s = latest THEN 'keep' ELSE 'cut' END AS role FROM (
  SELECT *, count(*) OVER w AS n, max(start_s) OVER w AS latest FROM u WHERE take_group IS NOT NULL WINDOW w AS (PARTITION BY k, take_group)) WHERE n >= 2),
c AS (SELECT u.*, count(*) OVER w AS n, max(start_s) OVER w AS latest, bool_and(x.id IS NOT NULL) OVER w AS covered, arg_min(u.id, start_s) OVER w AS a, arg_max(u.id, start_s) OVER w AS z
  FROM u LEFT JOIN x ON u.k = x.k AND u.id = x.id WHERE said <> '' WINDOW w AS (PARTITION BY u.k, said)),
r AS (SELECT k, 2 AS priority, a || '-' || z AS take, id, CASE WHEN start_s = latest THEN 'keep' ELSE 'cut' END AS role FROM c WHERE n >= 2 AND NOT covered),
xr AS (SELECT k, id FROM x UNION SELECT k, id FROM r),
b AS (SELECT b.*, row_number() OVER (PARTITION BY b.k, block ORDER BY start_s) AS i, xr.id IS NOT NULL AS covered FROM {_BLOCKS} b LEFT JOIN xr ON b.k = xr.k AND b.id = xr.id),
h AS (SELECT k, block, array_to_string({TOKENS_SQL.format("string_agg(text, ' ' ORDER BY i) FILTER (i <= 3)")}, ' ') AS head, bool_or(covered) AS taken, arg_min(id, i) AS a, arg_max(id, i) AS z FROM b GROUP BY k, block),
t AS (SELECT *, lead(block) OVER w AS nb, lead(a) OVER w AS na, lead(z) OVER w AS nz, sum(taken::INT) OVER w AS run FROM h WHERE head <> '' WINDOW w AS (PARTITION BY k, head ORDER BY block)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, head, run ORDER BY block) AS j FROM t WHERE NOT taken) WHERE j % 2 = 1 AND nb IS NOT NULL),
l AS (SELECT s.k, 3 AS priority, s.a || '-' || s.na AS take, b.id, CASE WHEN b.block = s.block THEN 'cut' WHEN b.id = s.nz THEN 'keep' ELSE 'member' END AS role
  FROM s JOIN b ON s.k = b.k AND b.block IN (s.block, s.nb)),
xrl AS (SELECT k, id FROM xr UNION SELECT k, id FROM l),
p AS (SELECT k, 4 AS priority, a || '-' || z AS take, id, CASE WHEN start_s = latest THEN 'keep' ELSE 'cut' END AS role FROM (
  SELECT u.*, count(*) OVER w AS n, max(start_s) OVER w AS latest, arg_min(u.id, start_s) OVER w AS a, arg_max(u.id, start_s) OVER w AS z
  FROM u LEFT JOIN xrl ON u.k = xrl.k AND u.id = xrl.id WHERE hook <> '' AND xrl.id IS NULL WINDOW w AS (PARTITION BY u.k, hook)) WHERE n >= 2)
SELECT * FROM x UNION ALL SELECT * FROM r UNION ALL SELECT * FROM l UNION ALL SELECT * FROM p)"""
_TAKE_REASON = "CASE priority WHEN 1 THEN 'latest-explicit-take' WHEN 2 THEN 'latest-repetition-cluster' WHEN 3 THEN 'latest-similar-block' ELSE 'latest-similar-prefix' END"


def grouped(spark, sf):
    group = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("g"), (F.length("text") % 4).cast("string")))
    return utterances(spark, sf).withColumn("take_group", group)


def _chain(spark, sf, similarity: float):
    rows = grouped(spark, sf)
    return ed.take_chain(rows, KeyLayout.measure(rows, ["k"], "start_s"), ORDER, "take_group", similarity, 3.5, HOOK)


@_q("take_chain", f"SELECT k, priority, {_TAKE_REASON} AS reason, take, id, role FROM {_CHAIN} c")
def _(spark, sf):
    return _chain(spark, sf, 1.0)


@_q("take_chain_similar")
def _(spark, sf):
    return _chain(spark, sf, ed.REPEAT_SIMILARITY)


@_q("chain_decisions", f"""WITH f AS (SELECT k, id, arg_min(proposal, priority) AS proposal FROM (
    SELECT k, id, priority, CASE priority WHEN 1 THEN 'proposed-take' WHEN 2 THEN 'proposed-repetition' WHEN 3 THEN 'proposed-retake-block' ELSE 'proposed-retake-prefix' END AS proposal
    FROM {_CHAIN} c WHERE role = 'cut' UNION ALL SELECT k, id, 5, 'proposed-repetition' FROM (
      SELECT *, max(start_s) OVER (PARTITION BY k, array_to_string({TOKENS_SQL.format('text')}, ' ')) AS latest FROM {UTTERANCES} u WHERE len({TOKENS_SQL.format('text')}) > 0) WHERE start_s < latest)
  GROUP BY k, id),
j AS (SELECT e.k, e.id, CASE WHEN e.kind = 'cut' THEN e.reason WHEN regexp_matches(e.text, '{MARKER_SQL}') THEN 'retake-marker' ELSE f.proposal END AS reason, e.kind AS was
  FROM {_REASONED} e LEFT JOIN f ON e.k = f.k AND e.id = f.id)
SELECT k, id, reason, CASE WHEN was = 'cut' OR reason IS NOT NULL THEN 'cut' ELSE 'keep' END AS kind FROM j""")
def _(spark, sf):
    takes = _chain(spark, sf, 1.0)
    later = ed.repeated_later(utterances(spark, sf), ["k"], "start_s", 1.0)
    return ed.proposed_cuts(reasoned(spark, sf), ed.take_proposals(takes, later, ["k"]), ["k"], MARKER).select("k", "id", "reason", "kind")


@_q("analysis_verdict", f"""SELECT u.k, coalesce(n, 0) AS candidates, CASE WHEN coalesce(n, 0) > 0 THEN 'CANDIDATES_PROPOSED' ELSE 'NO_CANDIDATES' END AS verdict
FROM (SELECT DISTINCT k FROM {UTTERANCES} u) u LEFT JOIN (SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT k, count(DISTINCT (priority, take)) AS n FROM {_CHAIN} c GROUP BY k
  UNION ALL SELECT k, count(*) FROM (SELECT k, end_s, lead(start_s) OVER (PARTITION BY k ORDER BY start_s, id) AS ns FROM {UTTERANCES} u) WHERE round(ns - end_s, 6) >= 0.8 GROUP BY k)
GROUP BY k) c ON u.k = c.k""")
def _(spark, sf):
    rows = utterances(spark, sf)
    takes = _chain(spark, sf, 1.0).select("k", "priority", "take").distinct()
    return ed.analysis_verdict(rows, [takes, pz.utterance_pauses(rows, PER_DOCUMENT, ORDER)], ["k"])


@_q("later_matches")
def _(spark, sf):
    rows = utterances(spark, sf)
    texts = ed.repeat_texts(rows, ["k"], "pos")
    return ed.later_matches(ed.repeat_pairs(rows, ["k"], "pos"), texts, ["k"])


def _cross(spark, sf, spoken=None):
    rows = (utterances(spark, sf) if spoken is None else spoken).select(
        F.col("source").alias("project"), F.col("k").cast("string").alias("segment_id"), "id", F.col("pos").alias("ordinal"), "text"
    )
    return rows, cr.cross_group_matches(rows, ["project"], "segment_id", "ordinal")


@_q("cross_group_matches")
def _(spark, sf):
    return _cross(spark, sf)[1]


@_q("keep_continuity")
def _(spark, sf):
    """The check of the film: only what is kept is matched."""
    rows, groups = _cross(spark, sf, reasoned(spark, sf).filter("kind = 'keep'"))
    return cr.keep_continuity(groups, rows.select("project").distinct(), ["project"])


@_q("group_ids", f"""SELECT text_key, members, 'take-' || left(md5(members || '|' || s || '|' || m), 16) AS group_id FROM (
  SELECT md5(text) AS text_key, count(*) AS members, sum(h) AS s, max(h) AS m FROM (
    SELECT text, ('0x' || left(md5(k || '|' || id), 15))::BIGINT AS h FROM {UTTERANCES} u) GROUP BY text)""")
def _(spark, sf):
    rows = utterances(spark, sf).withColumn("text_key", F.md5("text"))
    return cr.group_ids(rows, ["text_key"], ["k", "id"], "take-")


# Members in the order of recording and time; lists longer than a thousand are digested in two steps.
TREE = """SELECT {key}, CAST(sum(n) AS BIGINT) AS {count}{more}, {shown} FROM (
  SELECT {key}, c, count(*) AS n, sha256('[' || string_agg(item, ',' ORDER BY i) || ']') AS h{sums} FROM (SELECT *, (i - 1) // 1000 AS c FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM {rows} r)) GROUP BY {key}, c) GROUP BY {key}"""
TREE_DIGEST = """CASE WHEN count(*) = 1 THEN max(h) ELSE sha256('[' || string_agg('"' || h || '"', ',' ORDER BY c) || ']') END"""


@_q("member_ids", TREE.format(
    key="text_key", count="members", more="", sums="", order="k, id", shown=f"'take-' || left({TREE_DIGEST}, 16) AS group_id",
    rows=f"""(SELECT md5(text) AS text_key, k, id, '{{"k":"' || k || '","utterance":"' || id || '"}}' AS item FROM {UTTERANCES} u)"""))
def _(spark, sf):
    rows = utterances(spark, sf).select(F.md5("text").alias("text_key"), "k", F.col("id").alias("utterance"))
    return cr.member_ids(rows, ["text_key"], ["utterance", "k"], ["k", "utterance"], "take-")


@_q("tokens", f"SELECT k, id, array_to_string({TOKENS_SQL.format('text')}, ' ') AS tokens FROM {UTTERANCES} u")
def _(spark, sf):
    return utterances(spark, sf).select("k", "id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))
