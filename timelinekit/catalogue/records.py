"""Decision, lineage and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelinekit.catalogue.editorial import STARTS, TREE, TREE_DIGEST
from timelinekit.catalogue.standins import UTTERANCES, WORDS, table, utterances, words
from timelinekit.operators import contracts as ct
from timelinekit.operators import decisions as dc
from timelinekit.operators import editorial as ed
from timelinekit.operators import lineage as ln
from timelinekit.plans.layout import KeyLayout

QUERIES, SQL = {}, {}
PER_DOCUMENT = KeyLayout(("k",), "pos")


def _q(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Lines with faults put in by rule: repeated ids, reversed or overlapping ranges, blanks.
_FAULTY = f"""(SELECT k, CASE WHEN (k + pos) % 19 = 0 THEN 'u0001' ELSE id END AS id, pos, CASE WHEN pos % 13 = 5 THEN -1.0::DOUBLE ELSE start_s END AS start_s,
  CASE WHEN (k + pos) % 17 = 3 THEN start_s - 2.0 WHEN (k + pos) % 11 = 4 THEN end_s + 6.0 ELSE end_s END AS end_s,
  CASE WHEN (k * 3 + pos) % 23 = 1 THEN ' ' ELSE text END AS text FROM {UTTERANCES} u)"""


def _faulty(spark, sf):
    return utterances(spark, sf).selectExpr(
        "k", "CASE WHEN (k + pos) % 19 = 0 THEN 'u0001' ELSE id END AS id", "pos", "CASE WHEN pos % 13 = 5 THEN -1.0D ELSE start_s END AS start_s",
        "CASE WHEN (k + pos) % 17 = 3 THEN start_s - 2.0D WHEN (k + pos) % 11 = 4 THEN end_s + 6.0D ELSE end_s END AS end_s",
        "CASE WHEN (k * 3 + pos) % 23 = 1 THEN ' ' ELSE text END AS text",
    )


@_q("timeline_valid", f"""SELECT k, id, pos, CASE WHEN pos <> first THEN 'duplicate id' WHEN start_s < 0 THEN 'negative start' WHEN end_s <= start_s THEN 'empty range'
  WHEN start_s < coalesce(reach, -1) - 1e-6 THEN 'overlap' WHEN trim(text) = '' THEN 'empty text' END AS reject FROM (
  SELECT *, min(pos) OVER (PARTITION BY k, id) AS first, max(end_s) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_FAULTY} f)""")
def _(spark, sf):
    return dc.timeline_valid(_faulty(spark, sf), PER_DOCUMENT, ["pos"]).select("k", "id", "pos", "reject")


_EDITED = f"""(SELECT k, CASE WHEN pos % 5 = 0 THEN 'u' || (pos + 1) WHEN pos % 5 = 1 THEN id || 'p2' WHEN pos % 5 = 2 THEN 'u' || (pos + 900) || 'x1' WHEN pos % 5 = 3 THEN 'z' || pos ELSE id END AS id,
  CASE WHEN pos % 2 = 1 THEN start_s + 0.5 END AS start_s, CASE WHEN pos % 2 = 1 THEN end_s END AS end_s FROM {UTTERANCES} u)"""
_NUM = r"lpad(regexp_extract({0}, '^u0*([0-9]+)((?:[px][0-9]+)*)$', 1), CAST(greatest(length(regexp_extract({0}, '^u0*([0-9]+)((?:[px][0-9]+)*)$', 1)), 4) AS INT), '0')"
_CANON = "CASE WHEN regexp_matches({0}, '^u0*[0-9]+(?:[px][0-9]+)*$') THEN 'u' || " + _NUM + " || regexp_extract({0}, '^u0*([0-9]+)((?:[px][0-9]+)*)$', 2) ELSE {0} END"
_PARENT = r"CASE WHEN regexp_matches({0}, '^u0*[0-9]+(?:[px][0-9]+)+$') THEN 'u' || " + _NUM + " END"


@_q("enrich_from_source", f"""SELECT e.k, e.id, coalesce(o.start_s, e.start_s) AS start_s, coalesce(o.end_s, e.end_s) AS end_s, coalesce(o.w, p.w) AS word_count,
  CASE WHEN o.id IS NULL AND e.parent IS NULL THEN 'unknown id' WHEN o.id IS NULL AND p.id IS NULL THEN 'unknown parent'
    WHEN o.id IS NULL AND coalesce(e.end_s, 0) <= coalesce(e.start_s, 0) THEN 'part without bounds' END AS reject
FROM (SELECT *, {_CANON.format('id')} AS own, {_PARENT.format('id')} AS parent FROM {_EDITED} x) e
LEFT JOIN (SELECT k, id, start_s, end_s, length(text) AS w FROM {UTTERANCES} u) o ON e.k = o.k AND e.own = o.id
LEFT JOIN (SELECT k, id, length(text) AS w FROM {UTTERANCES} u) p ON e.k = p.k AND e.parent = p.id""")
def _(spark, sf):
    rows = utterances(spark, sf)
    edited = rows.selectExpr(
        "k", "CASE WHEN pos % 5 = 0 THEN concat('u', pos + 1) WHEN pos % 5 = 1 THEN concat(id, 'p2') WHEN pos % 5 = 2 THEN concat('u', pos + 900, 'x1') "
        "WHEN pos % 5 = 3 THEN concat('z', pos) ELSE id END AS id", "CASE WHEN pos % 2 = 1 THEN start_s + 0.5D END AS start_s", "CASE WHEN pos % 2 = 1 THEN end_s END AS end_s",
    )
    return dc.enrich_from_source(edited, rows.withColumn("word_count", F.length("text")), ["k"])


@_q("apply_text_rules", "SELECT doc_id, md5(replace(replace(replace(text, 'the ', 'THE '), 'THE a', 'an a'), 'le ', 'LE ')) AS digest FROM documents")
def _(spark, sf):
    rules = [("the ", "THE "), ("THE a", "an a"), ("le ", "LE ")]
    return table(spark, sf, "documents").select("doc_id", F.md5(dc.apply_text_rules(F.col("text"), rules)).alias("digest"))


@_q("rule_regression", """SELECT source, count(*) AS cases, CASE WHEN bool_or(text = upper(text)) OR NOT bool_and(replace(text, ' the ', ' THE ') = replace(text, ' the ', ' THE ')) THEN 'FAIL' ELSE 'PASS' END AS verdict
FROM documents GROUP BY source""")
def _(spark, sf):
    cases = table(spark, sf, "documents")
    after = dc.apply_text_rules(F.col("text"), [(" the ", " THE ")])
    # Expected: the upper-case article; a text that is upper case already was right before.
    before = F.when(F.col("text") == F.upper("text"), after).otherwise(F.concat("text", F.lit(" ")))
    return dc.rule_regression(cases, ["source"], before, after, F.replace("text", F.lit(" the "), F.lit(" THE ")))


_OVERLAYS = f"""(SELECT k, 'v' || (pos % 7) AS overlay_id, CASE WHEN pos % 6 = 0 THEN 'none-such' ELSE id END AS anchor,
  CASE WHEN (k + pos) % 9 = 0 THEN 'hologram' ELSE 'motion' END AS type, CASE WHEN pos % 5 = 4 THEN 0.0::DOUBLE END AS duration_s FROM {UTTERANCES} u)"""
_KINDS = f"(SELECT k, id, CASE WHEN (k + pos) % 3 = 0 THEN 'cut' ELSE 'keep' END AS kind FROM {UTTERANCES} u)"


def _kinds(spark, sf):
    return utterances(spark, sf).withColumn("kind", F.expr("CASE WHEN (k + pos) % 3 = 0 THEN 'cut' ELSE 'keep' END"))


@_q("orphan_anchors", f"""SELECT o.k, overlay_id, anchor, CASE WHEN n > 1 THEN 'duplicate overlay id' WHEN type <> 'motion' THEN 'unsupported type'
  WHEN coalesce(duration_s, 1) <= 0 THEN 'bad duration' WHEN e.kind IS NULL THEN 'unknown anchor' WHEN e.kind <> 'keep' THEN 'anchor is cut' END AS fault
FROM (SELECT *, count(*) OVER (PARTITION BY k, overlay_id) AS n FROM {_OVERLAYS} v) o LEFT JOIN {_KINDS} e ON o.k = e.k AND o.anchor = e.id""")
def _(spark, sf):
    rows = _kinds(spark, sf)
    overlays = rows.selectExpr(
        "k", "concat('v', pos % 7) AS overlay_id", "CASE WHEN pos % 6 = 0 THEN 'none-such' ELSE id END AS anchor",
        "CASE WHEN (k + pos) % 9 = 0 THEN 'hologram' ELSE 'motion' END AS type", "CASE WHEN pos % 5 = 4 THEN 0.0D END AS duration_s",
    )
    return dc.orphan_anchors(overlays, rows, ["k"]).select("k", "overlay_id", "anchor", "fault")


_DECISIONS = f"""(SELECT k, CASE WHEN pos % 10 = 9 THEN 'u9999' WHEN pos % 10 = 8 THEN 'u0001' ELSE id END AS id, CASE WHEN pos % 3 = 0 THEN 'cut' WHEN pos % 11 = 7 THEN 'maybe' ELSE 'keep' END AS kind,
  CASE WHEN pos % 3 = 0 AND pos % 4 <> 2 THEN 'off topic' END AS reason FROM {UTTERANCES} u WHERE pos % 4 <> 1)"""


def _decisions(spark, sf):
    return utterances(spark, sf).filter("pos % 4 <> 1").selectExpr(
        "k", "CASE WHEN pos % 10 = 9 THEN 'u9999' WHEN pos % 10 = 8 THEN 'u0001' ELSE id END AS id",
        "CASE WHEN pos % 3 = 0 THEN 'cut' WHEN pos % 11 = 7 THEN 'maybe' ELSE 'keep' END AS kind", "CASE WHEN pos % 3 = 0 AND pos % 4 <> 2 THEN 'off topic' END AS reason",
    )


@_q("apply_decisions", rf"""WITH d AS (SELECT k, id, kind, reason, row_number() OVER (PARTITION BY k, id ORDER BY coalesce(reason, ''), kind) AS r FROM {_DECISIONS} x),
h AS (SELECT k, id, text, len(regexp_extract_all(text, '(?i)^(?:{STARTS})')) + len(regexp_extract_all(text, '(?i)[.!?…]\s(?:{STARTS})')) AS hooks FROM {UTTERANCES} u)
SELECT h.k, h.id, coalesce(d.kind, 'cut') AS kind, CASE WHEN d.k IS NULL THEN 'внутренние повторы' WHEN d.kind = 'cut' THEN trim(d.reason) END AS reason,
  CASE WHEN coalesce(d.kind, 'cut') = 'keep' AND hooks >= 2 THEN 'keep on several takes' END AS reject
FROM h LEFT JOIN d ON h.k = d.k AND h.id = d.id AND d.r = 1""")
def _(spark, sf):
    # Decisions of one id agree on their smallest reason, then kind.
    rows = _decisions(spark, sf).groupBy("k", "id").agg(F.min(F.struct(F.coalesce("reason", F.lit("")).alias("o"), "kind", "reason")).alias("d"))
    first = rows.select("k", "id", "d.kind", "d.reason")
    out = dc.apply_decisions(utterances(spark, sf), first, ["k"], ed.false_cohesion(F.col("text"), STARTS))
    return out.select("k", "id", "kind", "reason", "reject")


@_q("decision_faults", f"""SELECT k, id, kind, fault FROM (SELECT d.k, d.id, d.kind, CASE WHEN n > 1 THEN 'duplicate id' WHEN d.kind NOT IN ('keep', 'cut') THEN 'invalid kind'
    WHEN d.kind = 'cut' AND coalesce(trim(reason), '') = '' THEN 'cut without reason' WHEN e.id IS NULL THEN 'unknown id' END AS fault
  FROM (SELECT *, count(*) OVER (PARTITION BY k, id) AS n FROM {_DECISIONS} x) d LEFT JOIN (SELECT k, id FROM {UTTERANCES} u) e ON d.k = e.k AND d.id = e.id) WHERE fault IS NOT NULL""")
def _(spark, sf):
    return dc.decision_faults(_decisions(spark, sf), utterances(spark, sf), ["k"]).select("k", "id", "kind", "fault")


@_q("decision_coverage", f"""SELECT d.doc_id AS k, coverage_end_s, coalesce(coverage_end_s + 1 >= n_chars / 10.0::DOUBLE, false) AS covered FROM documents d LEFT JOIN (
  SELECT k, max(end_s) AS coverage_end_s FROM {UTTERANCES} u GROUP BY k) e ON d.doc_id = e.k""")
def _(spark, sf):
    media = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), (F.col("n_chars") / 10).alias("duration_s"))
    return dc.decision_coverage(utterances(spark, sf), media, ["k"]).select("k", "coverage_end_s", "covered")


@_q("scene_contract", f"""WITH s AS (SELECT k, 's' || (pos % 9) AS scene_id, id AS anchor, source AS recipe, CASE WHEN pos % 4 = 0 THEN '' ELSE lang END AS title, pos % 5 AS lines FROM {UTTERANCES} u),
r AS (SELECT source AS recipe, count(*) % 7 = 0 AS reserved, count(*) % 2 = 0 AS needs_list FROM documents WHERE source <> 'src3' GROUP BY source),
n AS (SELECT *, count(*) OVER (PARTITION BY k, scene_id) AS n FROM s)
SELECT n.k, scene_id, CASE WHEN r.recipe IS NULL THEN 'unknown recipe' WHEN reserved THEN 'reserved recipe' WHEN n > 1 THEN 'duplicate scene id'
  WHEN e.kind <> 'keep' THEN 'anchor is not kept' WHEN title = '' THEN 'field missing' WHEN needs_list AND lines < 3 THEN 'list too short' END AS fault
FROM n LEFT JOIN r ON n.recipe = r.recipe LEFT JOIN {_KINDS} e ON n.k = e.k AND n.anchor = e.id""")
def _(spark, sf):
    rows = _kinds(spark, sf)
    scenes = rows.select(
        "k", F.expr("concat('s', pos % 9)").alias("scene_id"), F.col("id").alias("anchor"), F.col("source").alias("recipe"),
        F.create_map(F.lit("title"), F.expr("CASE WHEN pos % 4 = 0 THEN '' ELSE lang END")).alias("fields"), F.expr("pos % 5").alias("lines"),
    )
    recipes = table(spark, sf, "documents").filter("source <> 'src3'").groupBy(F.col("source").alias("recipe")).agg(
        F.expr("count(1) % 7 = 0").alias("reserved"), F.expr("count(1) % 2 = 0").alias("needs_list")
    ).withColumn("required", F.array(F.lit("title")))
    return dc.scene_contract(scenes, recipes, rows, ["k"])


_OPS = f"""(SELECT k, pos AS seq, CASE WHEN pos % 8 = 7 THEN 'u9999' ELSE printf('u%04d', pos // 2 + 1) END AS id, ['cut', 'keep', 'replace-text', 'set-visual', 'remove-visual', 'cut'][pos % 6 + 1] AS operation,
  CASE WHEN pos % 6 IN (2, 3) THEN lang || (pos % 2) END AS value FROM {UTTERANCES} u)"""


def _operations(spark, sf):
    return utterances(spark, sf).selectExpr(
        "k", "pos AS seq", "CASE WHEN pos % 8 = 7 THEN 'u9999' ELSE format_string('u%04d', cast(floor(pos / 2) + 1 AS int)) END AS id",
        "element_at(array('cut', 'keep', 'replace-text', 'set-visual', 'remove-visual', 'cut'), pos % 6 + 1) AS operation",
        "CASE WHEN pos % 6 IN (2, 3) THEN concat(lang, pos % 2) END AS value",
    )


def _visual_entries(spark, sf):
    return _kinds(spark, sf).select("k", "id", "kind", "text", F.lit(None).cast("string").alias("visual"))


@_q("apply_revisions", f"""WITH l AS (SELECT k, id, arg_max(operation, seq) FILTER (operation IN ('cut', 'keep')) AS kind, arg_max(value, seq) FILTER (operation = 'replace-text') AS text,
    arg_max(CASE WHEN operation = 'set-visual' THEN value ELSE '' END, seq) FILTER (operation IN ('set-visual', 'remove-visual')) AS visual FROM {_OPS} o GROUP BY k, id)
SELECT e.k, e.id, coalesce(l.kind, e.kind) AS kind, md5(coalesce(l.text, u.text)) AS text, nullif(l.visual, '') AS visual
FROM {_KINDS} e JOIN {UTTERANCES} u ON e.k = u.k AND e.id = u.id LEFT JOIN l ON e.k = l.k AND e.id = l.id""")
def _(spark, sf):
    out = dc.apply_revisions(_visual_entries(spark, sf), _operations(spark, sf), ["k"])
    return out.select("k", "id", "kind", F.md5("text").alias("text"), "visual")


@_q("revision_errors", f"""WITH j AS (SELECT o.*, e.kind, u.text, CASE WHEN operation IN ('cut', 'keep') THEN 'kind' WHEN operation = 'replace-text' THEN 'text' ELSE 'visual' END AS slot,
    CASE WHEN operation IN ('cut', 'keep') THEN operation WHEN operation = 'remove-visual' THEN '' ELSE coalesce(value, '') END AS wanted
  FROM {_OPS} o LEFT JOIN {_KINDS} e ON o.k = e.k AND o.id = e.id LEFT JOIN {UTTERANCES} u ON o.k = u.k AND o.id = u.id),
p AS (SELECT *, lag(wanted) OVER (PARTITION BY k, id, slot ORDER BY seq) AS was FROM j)
SELECT * FROM (SELECT k, id, seq, operation, CASE WHEN kind IS NULL THEN 'unknown entry' WHEN wanted = coalesce(was, CASE slot WHEN 'kind' THEN kind WHEN 'text' THEN text ELSE '' END) THEN 'no change' END AS error FROM p) WHERE error IS NOT NULL""")
def _(spark, sf):
    return dc.revision_errors(_visual_entries(spark, sf), _operations(spark, sf), KeyLayout(("k", "id"), "seq"))


# Orders are approved files, their lines the files found now.
_FOUND = """(SELECT 'o' || l_orderkey AS path, min(l_returnflag) AS kind, md5(CAST(count(*) AS VARCHAR)) AS sha256, count(*) AS size_bytes FROM lineitem GROUP BY l_orderkey)"""
_RECORDS = """(SELECT 'o' || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE 'A' END AS kind, md5(CAST(o_custkey % 7 AS VARCHAR)) AS sha256, o_custkey % 7 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS size_bytes FROM orders)"""
_BOUND = """(SELECT 'o' || o_orderkey AS path, md5(CAST(o_custkey % 6 AS VARCHAR)) AS sha256 FROM orders WHERE o_orderkey % 11 <> 0)"""


def _found(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path")).agg(
        F.min("l_returnflag").alias("kind"), F.md5(F.count(F.lit(1)).cast("string")).alias("sha256"), F.count(F.lit(1)).alias("size_bytes")
    )


def _records(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "concat('o', o_orderkey) AS path", "CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE 'A' END AS kind", "md5(cast(o_custkey % 7 AS string)) AS sha256",
        "o_custkey % 7 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS size_bytes",
    )


@_q("evidence_fresh", f"""SELECT r.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN r.size_bytes <> f.size_bytes THEN 'size changed' WHEN r.sha256 <> f.sha256 THEN 'content changed'
  WHEN r.kind <> f.kind THEN 'wrong kind' WHEN b.path IS NULL THEN 'not bound' WHEN b.sha256 <> f.sha256 THEN 'stale binding' END AS reason
FROM {_RECORDS} r LEFT JOIN {_FOUND} f ON r.path = f.path LEFT JOIN {_BOUND} b ON r.path = b.path""")
def _(spark, sf):
    bound = table(spark, sf, "orders").filter("o_orderkey % 11 <> 0").selectExpr("concat('o', o_orderkey) AS path", "md5(cast(o_custkey % 6 AS string)) AS sha256")
    return ln.evidence_fresh(_records(spark, sf), _found(spark, sf), bound).select("path", "reason")


@_q("reusable_jobs", """SELECT p.o_orderkey AS job_id, coalesce(p.o_orderstatus = 'F' AND p.o_custkey % 4 <> 0 AND v.ok, false) AS reuse FROM orders p LEFT JOIN (
  SELECT l_orderkey, bool_and(l_quantity > 5) AS ok FROM lineitem GROUP BY 1) v ON p.o_orderkey = v.l_orderkey""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    plan = orders.selectExpr("o_orderkey AS job_id", "'v2' AS worker_version", "md5(cast(o_custkey AS string)) AS fingerprint")
    ledger = orders.selectExpr(
        "o_orderkey AS job_id", "CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'RUNNING' END AS status", "'v2' AS worker_version",
        "md5(cast(CASE WHEN o_custkey % 4 = 0 THEN -1 ELSE o_custkey END AS string)) AS fingerprint",
    )
    outputs = table(spark, sf, "lineitem").selectExpr("l_orderkey AS job_id", "l_quantity > 5 AS valid")
    return ln.reusable_jobs(plan, ledger, outputs).select("job_id", "reuse")


@_q("inventory_snapshot", f"""SELECT kind, files, total_bytes, md5(files || '|' || total_bytes || '|' || s) AS plan_hash FROM (SELECT kind, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
  sum(('0x' || left(md5(path || '|' || sha256 || '|' || size_bytes), 15))::BIGINT) AS s FROM {_RECORDS} r GROUP BY kind)""")
def _(spark, sf):
    return ln.inventory_snapshot(_records(spark, sf), ["kind"])


@_q("inventory_digest", TREE.format(
    key="kind", count="files", more=", CAST(sum(size) AS BIGINT) AS total_bytes", sums=", sum(size_bytes) AS size", order="path, sha256", shown=f"{TREE_DIGEST} AS digest",
    rows=f"""(SELECT *, '{{"path":"' || path || '","sha256":"' || sha256 || '","size_bytes":' || CAST(size_bytes AS BIGINT) || '}}' AS item FROM {_RECORDS} r)"""))
def _(spark, sf):
    return ln.inventory_digest(_records(spark, sf), ["kind"])


@_q("snapshot_changes", f"""SELECT path, sha256, 'removed' AS change FROM (SELECT path, sha256 FROM {_RECORDS} r EXCEPT ALL SELECT path, sha256 FROM {_FOUND} f)
UNION ALL SELECT path, sha256, 'added' FROM (SELECT path, sha256 FROM {_FOUND} f EXCEPT ALL SELECT path, sha256 FROM {_RECORDS} r)""")
def _(spark, sf):
    return ln.snapshot_changes(_records(spark, sf), _found(spark, sf), ["path", "sha256"])


@_q("missing_items", """SELECT k, array_to_string(list_filter(want, lambda x: NOT list_contains(have, x)), ' ') AS missing FROM (
  SELECT o_orderkey AS k, ['a' || (o_custkey % 3), 'b' || (o_custkey % 2), 'c'] AS want, ['a' || (o_orderkey % 3), 'b' || (o_orderkey % 2)] AS have FROM orders)""")
def _(spark, sf):
    expected = F.array(F.expr("concat('a', o_custkey % 3)"), F.expr("concat('b', o_custkey % 2)"), F.lit("c"))
    applied = F.array(F.expr("concat('a', o_orderkey % 3)"), F.expr("concat('b', o_orderkey % 2)"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(ln.missing_items(expected, applied), " ").alias("missing"))


_RIGHTS = "['owned', 'licensed', 'generated', 'unknown'][CAST({0} % 4 AS INT) + 1]"


@_q("library_ingest", f"""SELECT sha256, 'asset-' || left(sha256, 16) AS id, min(path) AS path FROM (
  SELECT sha2_text AS sha256, path FROM (SELECT md5(p_name || p_type) AS sha2_text, 'p' || p_partkey AS path, {_RIGHTS.format('p_size')} AS rights FROM part) WHERE rights <> 'unknown')
WHERE sha256 NOT IN (SELECT md5(p_name || p_type) FROM part WHERE p_brand = 'Brand#2' AND p_size < 10) GROUP BY sha256""")
def _(spark, sf):
    part = table(spark, sf, "part")
    rights = F.element_at(F.array(*[F.lit(r) for r in ("owned", "licensed", "generated", "unknown")]), (F.col("p_size") % 4 + 1).cast("int"))
    new = part.select(F.md5(F.concat("p_name", "p_type")).alias("sha256"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), rights.alias("rights"))
    catalog = part.filter("p_brand = 'Brand#2' AND p_size < 10").select(F.md5(F.concat("p_name", "p_type")).alias("sha256"))
    return ln.library_ingest(new, catalog, 7)[0].select("sha256", "id", "path")


@_q("catalog_rejects", f"""WITH c AS (SELECT p_partkey AS ordinal, CASE WHEN p_size % 13 = 0 THEN 'bad id' WHEN p_size % 11 = 0 THEN 'a' || (p_partkey % 50) ELSE 'p' || p_partkey END AS id,
    CASE WHEN p_size % 7 = 0 THEN '../x' ELSE 'f' || (p_partkey % 1500) END AS path, md5(CAST(p_partkey % 1200 AS VARCHAR)) AS sha256, {_RIGHTS.format('p_size')} AS rights,
    CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_brand END AS provenance FROM part),
i AS (SELECT DISTINCT 'f' || (p_partkey % 1400) AS path, CASE WHEN p_partkey % 1400 % 10 <> 0 THEN md5(CAST(p_partkey % 1400 AS VARCHAR)) END AS sha256, p_partkey % 1400 % 17 <> 0 AS is_file FROM part)
SELECT ordinal, id, CASE WHEN NOT regexp_matches(id, '^[A-Za-z0-9][A-Za-z0-9_.-]*$') OR ordinal <> first THEN 'invalid-or-duplicate-id' WHEN rights = 'unknown' THEN 'rights-not-allowed'
  WHEN trim(provenance) = '' THEN 'provenance-missing' WHEN c.path = '../x' THEN 'path-outside-library' WHEN i.path IS NULL THEN 'file-missing' WHEN NOT is_file THEN 'not-a-regular-file'
  WHEN i.sha256 IS NULL THEN 'file-unreadable' WHEN i.sha256 <> c.sha256 THEN 'checksum-mismatch' END AS reject
FROM (SELECT *, min(ordinal) OVER (PARTITION BY id) AS first FROM c) c LEFT JOIN i ON c.path = i.path""")
def _(spark, sf):
    part = table(spark, sf, "part")
    catalog = part.selectExpr(
        "p_partkey AS ordinal", "CASE WHEN p_size % 13 = 0 THEN 'bad id' WHEN p_size % 11 = 0 THEN concat('a', p_partkey % 50) ELSE concat('p', p_partkey) END AS id",
        "CASE WHEN p_size % 7 = 0 THEN '../x' ELSE concat('f', p_partkey % 1500) END AS path", "md5(cast(p_partkey % 1200 AS string)) AS sha256",
        "element_at(array('owned', 'licensed', 'generated', 'unknown'), cast(p_size % 4 + 1 AS int)) AS rights", "CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_brand END AS provenance",
    )
    inventory = part.selectExpr(
        "concat('f', p_partkey % 1400) AS path", "CASE WHEN p_partkey % 1400 % 10 <> 0 THEN md5(cast(p_partkey % 1400 AS string)) END AS sha256", "p_partkey % 1400 % 17 <> 0 AS is_file"
    ).distinct()
    return ln.catalog_rejects(catalog, inventory).select("ordinal", "id", "reject")


@_q("stale_work", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3601 SECOND + INTERVAL 1 MICROSECOND AND event_type = 'error'")
def _(spark, sf):
    locks = table(spark, sf, "events").filter("event_type = 'error'").withColumnRenamed("ts", "heartbeat_at")
    return ln.stale_work(locks, F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")).select("event_id")


@_q("candidates_contract", """WITH f AS (SELECT o_custkey AS k, o_orderkey // 2 AS id, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL),
d AS (SELECT o_custkey AS k, o_orderkey // 2 AS id, count(*) AS n, bool_or(o_orderkey % 5 = 0) AS bad FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY ALL)
SELECT coalesce(f.k, d.k) AS k, coalesce(f.id, d.id) AS id, unnest(list_filter([CASE WHEN f.n > 1 THEN 'id listed twice' END, CASE WHEN d.n > 1 THEN 'id detailed twice' END,
  CASE WHEN d.n IS NULL THEN 'listed without detail' END, CASE WHEN f.n IS NULL THEN 'detail not listed' END, CASE WHEN bad THEN 'range and duration differ' END], lambda x: x IS NOT NULL)) AS rule
FROM f FULL JOIN d ON f.k = d.k AND f.id = d.id""")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("k", F.col("o_custkey")).withColumn("id", F.floor(F.col("o_orderkey") / 2))
    flat = orders.filter("o_orderkey % 7 <> 0")
    details = orders.filter("o_orderkey % 11 <> 0").selectExpr("k", "id", "10.0D AS start_s", "12.0D AS end_s", "CASE WHEN o_orderkey % 5 = 0 THEN 3.0D ELSE 2.0D END AS duration_s")
    return ct.candidates_contract(flat, details, ["k"])


_MEMBERS = """(SELECT l_orderkey AS g, 's' || (l_linenumber % 6) AS segment, l_partkey AS id, l_linenumber * 100000 + l_suppkey AS place, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_returnflag = 'R' END AS kept,
  CASE WHEN l_orderkey % 3 = 0 THEN 0.80 + l_discount ELSE 0.90 + l_discount END AS confidence, CASE WHEN l_orderkey % 3 = 0 THEN 'uncertain' ELSE 'recommended' END AS status FROM lineitem)"""


@_q("groups_contract", f"""WITH m AS (SELECT m.*, b.p_partkey IS NULL AS ghost FROM {_MEMBERS} m LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 3) b ON m.id = b.p_partkey),
x AS (SELECT g, max(n) AS twice FROM (SELECT g, segment, count(*) AS n FROM m GROUP BY ALL) GROUP BY g),
a AS (SELECT g, sum(CAST(ghost AS INT)) AS ghosts, count_if(kept) AS kept, max(CASE WHEN kept THEN place END) AS kept_at, max(place) AS latest, min(confidence) AS low, max(status) AS status, count(kept) AS act FROM m GROUP BY g)
SELECT a.g, unnest(list_filter([CASE WHEN ghosts > 0 THEN 'member is not bound' END, CASE WHEN twice > 1 THEN 'two members in one segment' END,
  CASE WHEN status = 'recommended' AND kept <> 1 THEN 'exactly one member must be kept' END, CASE WHEN status = 'recommended' AND kept_at <> latest THEN 'kept member is not the last' END,
  CASE WHEN (status = 'recommended' AND low < 0.92) OR (status <> 'recommended' AND (low < 0.84 OR low >= 0.92)) THEN 'confidence outside its band' END,
  CASE WHEN status <> 'recommended' AND act > 0 THEN 'uncertain group is actionable' END], lambda r: r IS NOT NULL)) AS rule FROM a JOIN x ON a.g = x.g""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    sure = F.col("l_orderkey") % 3 != 0
    members = lines.select(
        F.col("l_orderkey").alias("g"), F.expr("concat('s', l_linenumber % 6)").alias("segment"), F.col("l_partkey").alias("id"),
        F.expr("l_linenumber * 100000 + l_suppkey").alias("at"), F.when(sure, F.col("l_returnflag") == "R").alias("kept"),
        F.when(sure, F.lit(0.90) + F.col("l_discount")).otherwise(F.lit(0.80) + F.col("l_discount")).alias("confidence"),
        F.when(sure, F.lit("recommended")).otherwise(F.lit("uncertain")).alias("status"),
    )
    parts = table(spark, sf, "part").filter("p_size > 3").select(F.col("p_partkey").alias("id"))
    bindings = members.select("segment", "id").distinct().join(parts, "id", "left_semi")
    return ct.groups_contract(members, bindings, ["g"], "at")


@_q("report_contract", """SELECT k, unnest(list_filter([CASE WHEN v = 3 THEN 'unsupported schema version' END, CASE WHEN st <> 'F' THEN 'verdict is not PASS' END,
  CASE WHEN (v = 1 AND NOT (a AND b)) OR (v = 2 AND NOT (a AND b AND c AND d)) THEN 'component missing or failed' END, CASE WHEN pr THEN 'test provider' END], lambda r: r IS NOT NULL)) AS rule FROM (
  SELECT o_orderkey AS k, CAST(o_orderkey % 3 + 1 AS INT) AS v, o_orderstatus AS st, o_custkey % 4 <> 0 AS a, true AS b, o_custkey % 5 <> 0 AS c, o_custkey % 6 <> 0 AS d, o_custkey % 9 = 0 AS pr FROM orders)""")
def _(spark, sf):
    def part(name, n):
        return [F.lit(name), F.when(F.col("o_custkey") % n != 0, F.lit("PASS")).otherwise(F.lit("FAIL"))]

    reports = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("schema_version"),
        F.when(F.col("o_orderstatus") == "F", F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"),
        F.when(F.col("o_custkey") % 9 == 0, F.lit("fixture")).otherwise(F.lit("cloud")).alias("provider"),
        F.create_map(*part("transcript", 4), F.lit("technical"), F.lit("PASS"), *part("visual", 5), *part("motion", 6)).alias("components"),
    )
    return ct.report_contract(reports, ["k"])


@_q("technical_rules", """SELECT k, unnest(list_filter([CASE WHEN vs <> 1 THEN 'expected exactly one video stream' END, CASE WHEN w <> 1080 THEN 'resolution mismatch' END,
  CASE WHEN abs(fps - 30) > 0.05 THEN 'frame rate mismatch' END, CASE WHEN abs(d - 25) > 20.35 THEN 'duration mismatch' END, CASE WHEN peak IS NULL THEN 'audio loudness metrics unavailable' END,
  CASE WHEN peak > -0.1 THEN 'audio peak above the policy' END, CASE WHEN mean < -40 THEN 'audio is effectively silent' END], lambda r: r IS NOT NULL)) AS rule FROM (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, l_linenumber % 3 AS vs, CASE WHEN l_suppkey % 6 = 0 THEN 720 ELSE 1080 END AS w, 30 + (l_partkey % 3) * 0.04 AS fps, l_quantity AS d,
    CASE WHEN l_partkey % 50 <> 0 THEN l_tax - 0.15 END AS peak, -l_quantity AS mean FROM lineitem)""")
def _(spark, sf):
    probes = table(spark, sf, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k", "l_linenumber % 3 AS video_streams", "1 AS audio_streams", "CASE WHEN l_suppkey % 6 = 0 THEN 720 ELSE 1080 END AS width",
        "1920 AS height", "1080 AS want_width", "1920 AS want_height", "30 + (l_partkey % 3) * 0.04D AS fps", "30.0D AS want_fps", "l_quantity AS duration_s",
        "CASE WHEN l_quantity < 25 THEN greatest(l_quantity + 20, 0) ELSE l_quantity - 20 END AS near", "CASE WHEN l_partkey % 50 <> 0 THEN l_tax - 0.15D END AS peak_db", "-l_quantity AS mean_db",
    ).withColumn("want_duration_s", F.when(F.abs(F.col("duration_s") - 25) > 20.35, F.col("duration_s") + 9).otherwise(F.col("duration_s"))).drop("near")
    return ct.technical_rules(probes, ["k"])


@_q("render_policy", """WITH s AS (SELECT n_name AS style, n_nationkey % 3 AS al, CASE WHEN n_nationkey % 2 = 0 THEN '#E1C445' ELSE '#FFFFFF' END AS color, 20 + n_regionkey AS lo, 60 + n_nationkey AS hi FROM nation WHERE n_nationkey <> 4),
r AS (SELECT c_custkey AS k, n_name AS style, c_custkey % 90 AS px, c_custkey % 3 AS al, CASE WHEN c_custkey % 5 = 0 THEN '#ffffff' ELSE '#e1c445' END AS color, (c_custkey % 30) / 1000.0 AS dr, c_custkey % 70 AS tpx
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT k, unnest(list_filter([CASE WHEN s.style IS NULL THEN 'unknown style' END, CASE WHEN NOT px BETWEEN lo AND hi THEN 'caption size outside the style' END, CASE WHEN r.al <> s.al THEN 'caption alignment' END,
  CASE WHEN upper(r.color) <> upper(s.color) THEN 'caption colour' END, CASE WHEN dr > 0.01 THEN 'caption centre drifts' END, CASE WHEN tpx <= px THEN 'title is not larger than captions' END,
  CASE WHEN k % 13 = 0 THEN 'overlay replaces the picture' END, CASE WHEN k % 17 = 0 THEN 'director copy on screen' END], lambda x: x IS NOT NULL)) AS rule FROM r LEFT JOIN s ON r.style = s.style""")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    styles = nation.filter("n_nationkey <> 4").selectExpr(
        "n_name AS style", "n_nationkey % 3 AS alignment", "CASE WHEN n_nationkey % 2 = 0 THEN '#E1C445' ELSE '#FFFFFF' END AS color", "'serif' AS font_class",
        "20 + n_regionkey AS min_font_px", "60 + n_nationkey AS max_font_px",
    )
    customers = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    renders = customers.selectExpr(
        "c_custkey AS k", "n_name AS style", "c_custkey % 90 AS caption_px", "c_custkey % 3 AS caption_alignment", "CASE WHEN c_custkey % 5 = 0 THEN '#ffffff' ELSE '#e1c445' END AS caption_color",
        "'serif' AS caption_class", "(c_custkey % 30) / 1000 AS centre_drift", "c_custkey % 70 AS title_px", "0.7D AS title_top", "0.6D AS caption_top",
        "CASE WHEN c_custkey % 13 = 0 THEN 'replace' ELSE 'overlay' END AS overlay_mode", "CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS copy_leaks",
    )
    return ct.render_policy(renders, styles, ["k"])


@_q("style_defaults", """WITH s AS (SELECT n_name AS style, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END AS size, CASE WHEN n_nationkey % 3 <> 0 THEN 'c' || n_nationkey END AS color FROM nation WHERE n_nationkey <> 5
    UNION ALL SELECT 'default', 99, 'gold')
SELECT c_custkey AS k, CASE WHEN s.style IS NOT NULL THEN s.style ELSE 'default' END AS style, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 7 END, s.size, 99) AS size, coalesce(s.color, 'gold') AS color
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON s.style = n_name""")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    named = nation.filter("n_nationkey <> 5").selectExpr("n_name AS style", "CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END AS size", "CASE WHEN n_nationkey % 3 <> 0 THEN concat('c', n_nationkey) END AS color")
    default = nation.filter("n_nationkey = 5").selectExpr("'default' AS style", "99 AS size", "'gold' AS color")
    wanted = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey AS k", "n_name AS style", "CASE WHEN c_custkey % 5 = 0 THEN 7 END AS size", "cast(NULL AS string) AS color"
    )
    return ct.style_defaults(wanted, named.unionByName(default), ["size", "color"])


@_q("recipe_contract", """SELECT 'r' || (p_partkey % 1900) AS id, unnest(list_filter([CASE WHEN p_size % 10 = 0 THEN 'field missing: look' END, CASE WHEN p_size % 6 = 0 THEN 'needs tags' END,
  CASE WHEN p_size % 14 = 0 THEN 'needs situations' END, CASE WHEN count(*) OVER (PARTITION BY p_partkey % 1900) > 1 THEN 'duplicate id' END], lambda x: x IS NOT NULL)) AS rule FROM part""")
def _(spark, sf):
    recipes = table(spark, sf, "part").selectExpr(
        "concat('r', p_partkey % 1900) AS id", "p_name AS title", "p_type AS what_happens", "CASE WHEN p_size % 6 = 0 THEN cast(array() AS array<string>) ELSE array(p_brand) END AS tags",
        "CASE WHEN p_size % 14 = 0 THEN cast(array() AS array<string>) ELSE array(p_type) END AS situations", "array('x') AS anti_situations", "CASE WHEN p_size % 10 <> 0 THEN p_name END AS look", "'c' AS compositor",
    )
    return ct.recipe_contract(recipes)


@_q("recipe_search_text", """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN p_name ELSE lower(p_name || ' ' || p_type || ' ' || p_brand || ' #' || p_size) END AS search_text FROM part""")
def _(spark, sf):
    recipes = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_name AS title", "p_type AS what_happens", "array(p_brand, concat('#', p_size)) AS tags", "CASE WHEN p_size % 4 = 0 THEN p_name END AS search_text"
    )
    return ct.recipe_search_text(recipes, ["title", "what_happens"], ["tags"]).select("id", "search_text")


@_q("library_revision", f"""SELECT CAST(7 + CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS INTEGER) AS revision FROM (SELECT md5(p_name || p_type) AS h, {_RIGHTS.format('p_size')} AS rights FROM part)
WHERE rights <> 'unknown' AND h NOT IN (SELECT md5(p_name || p_type) FROM part WHERE p_brand = 'Brand#2' AND p_size < 10)""")
def _(spark, sf):
    part = table(spark, sf, "part")
    rights = F.element_at(F.array(*[F.lit(r) for r in ("owned", "licensed", "generated", "unknown")]), (F.col("p_size") % 4 + 1).cast("int"))
    content = F.md5(F.concat("p_name", "p_type")).alias("sha256")
    new = part.select(content, F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), rights.alias("rights"))
    return ln.library_ingest(new, part.filter("p_brand = 'Brand#2' AND p_size < 10").select(content), 7)[1]


# "de la" stands in for the brand said as two words; every fiftieth word is rewritten by hand.
_SPOKEN = f"""(SELECT *, CASE WHEN (k + pos) % 50 = 0 THEN 'Neu ' || text END AS rewrite FROM {WORDS} w)"""


@_q("overlay_corrections", f"""SELECT k, word_id, CASE WHEN opens THEN 'DE LA' WHEN rewrite IS NOT NULL THEN rewrite ELSE replace(replace(lower(text), 'ß', 'ss'), 'ё', 'е') END AS caption,
  start_s, CASE WHEN opens THEN next_end ELSE end_s END AS end_s FROM (
  SELECT *, fold = 'de' AND coalesce(starts_with(lead(fold) OVER w, 'la'), false) AS opens, starts_with(fold, 'la') AND coalesce(lag(fold) OVER w, '') = 'de' AS closes, lead(end_s) OVER w AS next_end
  FROM (SELECT *, replace(lower(coalesce(rewrite, text)), 'ё', 'е') AS fold FROM {_SPOKEN} s) WINDOW w AS (PARTITION BY k ORDER BY pos)) WHERE NOT closes""")
def _(spark, sf):
    said = words(spark, sf)
    rewrites = said.filter("(k + pos) % 50 = 0").select("k", "word_id", F.concat(F.lit("Neu "), "text").alias("rewrite"))
    return dc.overlay_corrections(said, rewrites, PER_DOCUMENT, ["pos"], ("de", "la", "DE LA"))
