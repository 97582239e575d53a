"""The given tables in the roles of feeds, transcripts, series and catalogs.

Each stand-in exists twice: as a DataFrame and as a SQL subquery, row for row the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# Parts per split of the input: a split's text takes some twenty times its room as words with their times.
PARTS_PER_SPLIT = 16


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key in parts so small that a part's words or lines are sorted in memory.

    The number is given, since adaptive execution sees the texts before they become words and would
    join parts until a task's words no longer fit.
    """
    return df.repartition(PARTS_PER_SPLIT * df.rdd.getNumPartitions(), key)


# Candidates: documents as feed items, doc_id as recency, labels as scores.
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    scored = docs.join(labels, "doc_id", "left")
    return scored.select(
        F.col("doc_id").alias("item_id"),
        F.col("lang").alias("category"),
        F.col("source").alias("feed"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.md5("text")).alias("url"),
        F.expr(
            "CASE WHEN doc_id % 17 <> 0 THEN "
            "timestampadd(MINUTE, doc_id * 5, TIMESTAMP_NTZ'2024-01-01 00:00:00') END"
        ).alias("published"),
        F.coalesce(F.expr("quality * 2 + (1 - toxic)"), F.lit(0)).cast("int").alias("score"),
        F.coalesce(F.expr("quality = 1 AND n_chars % 3 = 0"), F.lit(False)).alias("case"),
    )


CANDIDATES = """(
  SELECT d.doc_id AS item_id, lang AS category, source AS feed,
    split_part(text, chr(10), 1) AS title,
    'https://' || source || '.example.com/' || md5(text) AS url,
    CASE WHEN d.doc_id % 17 <> 0
      THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id * 5 AS BIGINT)) END AS published,
    CAST(coalesce(quality * 2 + (1 - toxic), 0) AS INTEGER) AS score,
    coalesce(quality = 1 AND n_chars % 3 = 0, false) AS "case"
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


# Series: events as samples per user; t in seconds from 2024-01-01.
def series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("k"),
        F.col("event_id").alias("id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1000000D").alias("t"),
        "event_type",
        "value",
    )


SERIES = """(
  SELECT user_id AS k, event_id AS id, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS t,
    event_type, value FROM events)"""


# Words: documents split at blanks; word i starts at 0.4 i, its length varies by a rule.
def words(spark: SparkSession, sf: str) -> DataFrame:
    # dealt by the key that windows over words ask for, before a row becomes many
    parts = dealt(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("k"), F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("pos", "text")
    )
    return parts.filter(F.col("text") != "").select(
        "k",
        F.format_string("w%06d", F.col("pos") + 1).alias("word_id"),
        "pos",
        "text",
        (F.col("pos") * 0.4).alias("start_s"),
        (F.col("pos") * 0.4 + (F.lit(5) + (F.col("k") * 7 + F.col("pos") * 13) % 30) / 100).alias("end_s"),
    )


WORDS = r"""(
  SELECT k, printf('w%06d', pos + 1) AS word_id, pos, text,
    pos * 0.4::DOUBLE AS start_s, pos * 0.4::DOUBLE + (5 + (k * 7 + pos * 13) % 30) / 100.0::DOUBLE AS end_s
  FROM (
    SELECT doc_id AS k, unnest(parts) AS text, CAST(unnest(range(len(parts))) AS INTEGER) AS pos
    FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS parts
          FROM documents)) WHERE text <> '')"""


# Utterances: document lines; line i starts at 5 i and lasts 1.0 to 4.9 seconds.
def utterances(spark: SparkSession, sf: str) -> DataFrame:
    lines = dealt(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id").select(
        F.col("doc_id").alias("k"), "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")
    )
    return lines.filter(F.trim("text") != "").select(
        "k",
        F.format_string("u%04d", F.col("pos") + 1).alias("id"),
        "pos",
        (F.col("pos") * 5.0).alias("start_s"),
        (F.col("pos") * 5.0 + (F.lit(10) + (F.col("k") * 3 + F.col("pos") * 7) % 40) / 10).alias("end_s"),
        F.trim("text").alias("text"),
        "lang",
        "source",
    )


UTTERANCES = """(
  SELECT k, printf('u%04d', pos + 1) AS id, pos, pos * 5.0::DOUBLE AS start_s,
    pos * 5.0::DOUBLE + (10 + (k * 3 + pos * 7) % 40) / 10.0::DOUBLE AS end_s, trim(text) AS text, lang, source
  FROM (
    SELECT doc_id AS k, lang, source, unnest(parts) AS text, CAST(unnest(range(len(parts))) AS INTEGER) AS pos
    FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents))
  WHERE trim(text) <> '')"""


# Lines of an order may share number, part and supplier; the price tells them apart.
SHOT_PLACE = (
    "l_linenumber * 100000000000000000 + l_partkey * 100000000000 + l_suppkey * 1000000"
    " + CAST(round(l_extendedprice * 100) AS BIGINT) % 1000000"
)


# Shots and entries: order lines in line order, quantity as duration in seconds.
def shots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.expr(SHOT_PLACE).alias("pos"),
        F.col("l_quantity").alias("duration_s"),
        F.when(F.col("l_returnflag") == "R", F.lit("cut")).otherwise(F.lit("keep")).alias("kind"),
        F.col("l_extendedprice").alias("price"),
    )


SHOTS = f"""(
  SELECT l_orderkey AS k, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
    {SHOT_PLACE} AS pos,
    l_quantity AS duration_s, CASE WHEN l_returnflag = 'R' THEN 'cut' ELSE 'keep' END AS kind,
    l_extendedprice AS price FROM lineitem)"""
