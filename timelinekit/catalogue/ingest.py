"""Source queries: raw feeds, transcripts, notes, markup and file lists built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelinekit.catalogue.feed import _ENT, _WS
from timelinekit.catalogue.standins import UTTERANCES, dealt, table, utterances
from timelinekit.functions import text as tx
from timelinekit.sources import feeds, markup, media

QUERIES, SQL = {}, {}


def _q(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _clean(sql: str) -> str:
    # Entities are decoded after the tags are gone.
    return f"trim(regexp_replace({_ENT.format(f'''regexp_replace({sql}, '<[^>]+>', ' ', 'g')''')}, '{_WS}+', ' ', 'g'))"


_FIRST_LINE = "split_part(text, chr(10), 1)"


@_q("feed_items", f"""SELECT feed, url, title, summary, published, length(fulltext) AS full_chars FROM (
  SELECT source AS feed, 'https://' || source || '.example.com/' || doc_id AS url, {_clean(_FIRST_LINE)} AS title, left({_clean('text')}, 600) AS summary,
    CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-01 06:30:00' + to_minutes(CAST(doc_id AS BIGINT)) END AS published,
    CASE WHEN doc_id % 2 = 0 AND length({_clean('text')}) > 400 THEN left({_clean('text')}, 5000) END AS fulltext FROM documents WHERE doc_id % 11 <> 0)
WHERE title <> '' AND (published IS NULL OR published >= TIMESTAMP '2024-01-01 08:00:00')""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    stamp = F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'2024-01-01 06:30:00')")
    item = F.concat(
        F.lit("<item><title>"), _xml(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("</title><link>https://"), "source",
        F.lit(".example.com/"), F.col("doc_id").cast("string"), F.lit("</link><description>"), _xml(F.col("text")), F.lit("</description>"),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<pubDate>Mon, "), F.date_format(stamp, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>")))
        .when(F.col("doc_id") % 3 == 2, F.concat(F.lit("<dc:date>"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</dc:date>"))).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<content:encoded>"), _xml(F.col("text")), F.lit("</content:encoded>"))).otherwise(F.lit("")), F.lit("</item>"),
    )
    # One raw document per item; some are cut off and therefore not well-formed.
    whole = F.concat(F.lit("<rss><channel><title>all</title>"), item, F.lit("</channel></rss>"))
    body = F.when(F.col("doc_id") % 11 == 0, F.left(whole, F.length(whole) - 9)).otherwise(whole)
    raw = docs.select(F.col("lang").alias("category"), F.col("source").alias("feed"), body.alias("body"))
    items = feeds.feed_items(raw, F.expr("TIMESTAMP'2024-01-01 08:00:00Z'"))
    published = F.expr("timestampadd(SECOND, cast(unix_seconds(published) AS int), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return items.select("feed", "url", "title", "summary", published.alias("published"), F.length("fulltext").alias("full_chars"))


@_q("feed_health", r"""SELECT feed, count(*) AS fetches, CAST(sum(items) AS BIGINT) AS items, count_if(NOT (code = 200 AND items > 0)) AS failures, bool_or(code = 200 AND items > 0) AS alive, max(error) AS last_error FROM (
  SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\.', '') AS feed, len(regexp_extract_all(html, '<li><a')) AS items, CASE WHEN page_id % 5 = 0 THEN 503 ELSE 200 END AS code,
    CASE WHEN page_id % 5 = 0 THEN left('bad gateway ' || url, 80) END AS error FROM pages) GROUP BY feed""")
def _(spark, sf):
    fetched = table(spark, sf, "pages").select(
        tx.source_host(F.col("url")).alias("feed"), F.expr("CASE WHEN page_id % 5 = 0 THEN 503 ELSE 200 END").alias("code"),
        F.replace(F.replace("html", F.lit("<item"), F.lit("<other")), F.lit("<li><a"), F.lit("<item><a")).alias("body"),
        F.expr("CASE WHEN page_id % 5 = 0 THEN concat('bad gateway ', url) END").alias("error"),
    )
    return feeds.feed_health(fetched)


def _payloads(spark, sf):
    """Recognition results per document; words of odd lines are missing, some are impossible."""
    rows = utterances(spark, sf)
    shift = F.when((F.col("k") % 13 == 5) & (F.col("pos") == 2), F.lit(9.0)).otherwise(F.lit(0.3))

    def timed(words):
        step = (F.col("end_s") - F.col("start_s")) / F.size(words)
        return F.transform(words, lambda w, i: F.struct(
            w.alias("word"), (F.col("start_s") + i * step - shift).alias("start"), (F.col("start_s") + (i + 1) * step - shift).alias("end"), F.lit(0.5).alias("confidence")
        ))

    spoken = tx.bound(F.split(F.trim("text"), " +"), timed)
    segment = F.struct(
        F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("text").alias("text"),
        F.when(F.col("pos") % 2 == 0, spoken).alias("words"),
    )
    listed = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", segment.alias("s")))).alias("_s"))  # lines of one document
    return listed.select("k", F.to_json(F.struct(F.transform("_s", lambda r: r["s"]).alias("segments"))).alias("body"))


_HEARD = rf"""(SELECT k, pos, i, w[i + 1] AS text, greatest(s, least(s + i * st - sh, e - 0.0001::DOUBLE)) AS a, s + (i + 1) * st - sh AS raw_e, s, e FROM (
  SELECT k, pos, w, unnest(range(len(w))) AS i, start_s AS s, end_s AS e, (end_s - start_s) / len(w) AS st, CASE WHEN pos % 2 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS sh FROM (
    SELECT *, list_filter(string_split_regex(trim(text), CASE WHEN pos % 2 = 0 THEN ' +' ELSE '[ \t\n\x0B\f\r]+' END), lambda x: x <> '') AS w FROM {UTTERANCES} u)))"""


@_q("transcript_words", f"""SELECT k, word_id, text, round_even(a, 9) AS start_s, round_even(least(e, greatest(raw_e, a + 0.0001::DOUBLE)), 9) AS end_s FROM (
  SELECT *, printf('w%06d', row_number() OVER (PARTITION BY k ORDER BY pos, i)) AS word_id FROM {_HEARD} h WHERE NOT (k % 13 = 5 AND k IN (SELECT k FROM {UTTERANCES} u WHERE pos = 2)))""")
def _(spark, sf):
    return media.explode_transcripts(_payloads(spark, sf), "k", "body", 9)[1].select("k", "word_id", "text", "start_s", "end_s")


@_q("transcript_rejects", f"SELECT k, 'invalid word timing' AS reason FROM {UTTERANCES} u WHERE k % 13 = 5 AND pos = 2")
def _(spark, sf):
    return media.explode_transcripts(_payloads(spark, sf), "k", "body")[2].select("k", "reason")


@_q("segment_words")
def _(spark, sf):
    """Every line as a recording: words with a pause after each eleventh, marks as own elements."""
    words = F.split(F.trim("text"), " +")
    elements = F.flatten(F.transform(words, lambda w, i: F.array(
        F.struct(F.lit("text").alias("kind"), F.regexp_replace(w, r"[.,]+$", "").alias("value"), (i * 0.4 + F.floor(i / 11)).alias("start_s"),
                 (i * 0.4 + F.floor(i / 11) + 0.3).alias("end_s"), F.lit(0).alias("monologue")),
        F.struct(F.lit("punct").alias("kind"), F.regexp_extract(w, r"([.,]+)$", 1).alias("value"), F.lit(None).cast("double").alias("start_s"),
                 F.lit(None).cast("double").alias("end_s"), F.lit(0).alias("monologue")),
    )))
    lines = utterances(spark, sf).select(F.concat_ws("-", "k", "id").alias("k"), "text")
    # lines move as texts to the parts their words are sorted in
    rows = lines.repartition(lines.rdd.getNumPartitions(), "k").select("k", elements.alias("elements"))
    return media.segment_words(rows, "k")


@_q("inventory_faults", """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_suppkey % 3 = 0 THEN 'screen' WHEN l_suppkey % 3 = 1 THEN 'audio' ELSE 'camera' END AS role, md5(CAST(l_partkey % 60 AS VARCHAR)) AS sha256,
    CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_linenumber END AS num, 'clip_' || l_suppkey || '.mp4' AS unnamed FROM lineitem),
g AS (SELECT k, num, bool_or(role <> 'audio') AS video FROM f WHERE num IS NOT NULL GROUP BY ALL)
SELECT k, 'duplicate content' AS fault, sha256 AS detail FROM f GROUP BY k, sha256 HAVING count(*) > 1
UNION ALL SELECT k, 'no segment number', CASE role WHEN 'screen' THEN 'screen_' WHEN 'audio' THEN 'mic_' ELSE 'cam_' END || unnamed FROM f WHERE num IS NULL
UNION ALL SELECT k, 'duplicate role', num || ' ' || role FROM f WHERE num IS NOT NULL GROUP BY k, num, role HAVING count(*) > 1
UNION ALL SELECT k, 'number gap', min(num) || '-' || max(num) FROM g GROUP BY k HAVING max(num) - min(num) + 1 <> count(*)
UNION ALL SELECT k, 'no video', CAST(num AS VARCHAR) FROM g WHERE NOT video""")
def _(spark, sf):
    files = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS k", """concat(CASE WHEN l_partkey % 9 = 0 THEN '' ELSE concat(lpad(cast(l_linenumber AS string), 2, '0'), '_') END, element_at(array('screen_', 'mic_', 'cam_'), cast(l_suppkey % 3 + 1 AS int)),
        'clip_', l_suppkey, '.mp4') AS name""", "md5(cast(l_partkey % 60 AS string)) AS sha256", "cast(l_quantity AS bigint) AS size_bytes",
    )
    return media.inventory_faults(media.describe_files(files), ["k"])


_NOTE_MIN = "CAST(o_orderkey % 50 AS BIGINT)"


def _notes(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS k", """concat('# notes\n- [fix ', CASE WHEN o_orderkey % 4 = 0 THEN 'blocking' ELSE 'speech' END, '] segment=', o_custkey % 100, ' range=', o_orderkey % 50, ':10.5-', o_custkey % 50, ':40 cut entry=u', o_orderkey % 9,
        '\n\n- [rule candidate] scope=project ', o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN '\nwhatever' ELSE '' END, '\n- [fix audio] segment=', o_custkey % 100, ' louder please') AS content""",
    )


@_q("parse_notes", f"""SELECT k, id, kind, segment_id, start_s, end_s, description, kind = 'blocking' AS blocking FROM (
  SELECT o_orderkey AS k, 'fix-001' AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'blocking' ELSE 'speech' END AS kind, CAST(o_custkey % 100 AS VARCHAR) AS segment_id, (o_orderkey % 50) * 60 + 10.5::DOUBLE AS start_s,
    (o_custkey % 50) * 60 + 40.0::DOUBLE AS end_s, 'cut entry=u' || (o_orderkey % 9) AS description FROM orders WHERE (o_custkey % 50) * 60 + 40 > (o_orderkey % 50) * 60 + 10.5
  UNION ALL SELECT o_orderkey, 'fix-002', 'audio', CAST(o_custkey % 100 AS VARCHAR), NULL, NULL, 'louder please' FROM orders)""")
def _(spark, sf):
    return markup.parse_notes(_notes(spark, sf), "k", "content")[0].drop("line_no")


@_q("parse_note_rejects", """SELECT o_orderkey AS k, 'unknown line' AS reason FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'reversed range' FROM orders WHERE (o_custkey % 50) * 60 + 40 <= (o_orderkey % 50) * 60 + 10.5""")
def _(spark, sf):
    return markup.parse_notes(_notes(spark, sf), "k", "content")[2].drop("line_no")


def _scripts(spark, sf):
    # dealt before a row becomes a file: a task of the table's size would parse some ten times its bytes
    return dealt(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey").selectExpr(
        "o_orderkey AS k", """concat('# scene\n[0:01.5 — 0:0', 2 + o_orderkey % 7, '] KEEP id=u0001 words=w1,w2\nhello ', o_orderstatus, '\nand more\n\n[0:09] MOTION m1 (начало) @u0001\n(поверх речи, тихо) big ', o_custkey, '\n[0:12] MOTION m1 (конец)\n',
        '[0:13 -> 0:20] CUT (', CASE WHEN o_orderkey % 2 = 0 THEN 'фальстарт' ELSE 'other' END, ') id=u0002\n**bad take**\n[0:21] КОНЕЦ СЕГМЕНТА\n', CASE WHEN o_orderkey % 5 = 0 THEN 'stray\n' ELSE '' END) AS content""",
    )


@_q("parse_markup", """SELECT o_orderkey AS k, 'u0001' AS id, 'keep' AS kind, 1.5::DOUBLE AS start_s, 2.0::DOUBLE + o_orderkey % 7 AS end_s, NULL AS reason, 'w1 w2' AS words, 'hello ' || o_orderstatus || chr(10) || 'and more' AS text FROM orders
UNION ALL SELECT o_orderkey, 'u0002', 'cut', 13.0, 20.0, CASE WHEN o_orderkey % 2 = 0 THEN 'false-start' ELSE 'other' END, '', 'bad take' FROM orders""")
def _(spark, sf):
    entries = markup.parse_markup(_scripts(spark, sf), "k", "content")[0]
    return entries.withColumn("words", F.array_join("word_ids", " ")).drop("line_no", "word_ids")


@_q("parse_markup_overlays", "SELECT o_orderkey AS k, 'm1' AS overlay_id, 'u0001' AS anchor, 'motion' AS type, 9.0::DOUBLE AS start_s, 12.0::DOUBLE AS end_s, 'big ' || o_custkey AS brief FROM orders")
def _(spark, sf):
    return markup.parse_markup(_scripts(spark, sf), "k", "content")[1].drop("line_no", "asset")


@_q("parse_markup_rejects", "SELECT o_orderkey AS k, 'text outside a block' AS reason FROM orders WHERE o_orderkey % 5 = 0")
def _(spark, sf):
    return markup.parse_markup(_scripts(spark, sf), "k", "content")[2].drop("line_no")
