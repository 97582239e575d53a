"""Feed registry, feed documents, fetch health and dated outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelinekit.functions.text import (
    FULLTEXT_CHARS, FULLTEXT_MIN_CHARS, SUMMARY_CHARS, clean_html, parse_published, squeeze, strip_aggregator_suffix,
    strip_tags,
)

# ---- fixed values -------------------------------------------------------------------------
FULLTEXT_TAGS = ("encoded", "full-text", "fulltext", "content")
SUMMARY_TAGS = ("description", "summary", "content")
DATE_TAGS = ("pubDate", "published", "updated", "date")
# -------------------------------------------------------------------------------------------


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``category|feed|url[|route]`` lines; blank lines and ``#`` comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", r"\|")
    return lines.select(
        F.try_element_at(parts, F.lit(1)).alias("category"), F.try_element_at(parts, F.lit(2)).alias("feed"),
        F.try_element_at(parts, F.lit(3)).alias("url"), F.try_element_at(parts, F.lit(4)).alias("route"),
    )


def _text(body: Column) -> Column:
    """Text of an element: CDATA as it is, otherwise entities of the document decoded once."""
    plain = body
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    cdata = F.regexp_extract(body, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    return F.when(body.rlike(r"(?s)^\s*<!\[CDATA\["), cdata).otherwise(plain)


def feed_items(raw: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Items of feed documents (category, feed, body), RSS, RDF or Atom.

    A document that is not well-formed gives no rows. Children of an item are read in
    document order: the first title, link and summary count, the longest full text is kept.
    """
    checked = F.from_xml(
        "body", "_bad string, _probe string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}
    )
    fragments = F.regexp_extract_all("body", F.lit(r"(?s)<(?:[\w.-]+:)?(item|entry)(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?\1\s*>"), F.lit(2))
    # An array that is exploded keeps later filters from running what made it anew: Spark would put the tests of a title, a link
    # and a date below the parts of an item, and those of an item below the document.
    each = raw.select("category", "feed", F.explode(F.array(F.struct(checked.alias("_x"), fragments.alias("_items")))).alias("_doc"))
    whole = F.col("_doc._x._bad").isNull() & F.col("_doc._x").isNotNull()
    items = each.select("category", "feed", F.explode_outer(F.when(whole, F.col("_doc._items"))).alias("_item")).filter("_item IS NOT NULL")
    child = r"(?s)<(?:[\w.-]+:)?([\w-]+)((?:\s[^>]*?)?)(?:/>|>((?:\s*<!\[CDATA\[.*?\]\]>\s*)|.*?)</(?:[\w.-]+:)?\1\s*>)"
    parts = F.arrays_zip(*[F.regexp_extract_all("_item", F.lit(child), F.lit(i)).alias(n) for i, n in ((1, "tag"), (2, "attrs"), (3, "body"))])
    split = F.transform(parts, lambda n: F.struct(
        n["tag"].alias("tag"), _text(n["body"]).alias("body"), F.regexp_extract(n["attrs"], r"href\s*=\s*[\"']([^\"']*)", 1).alias("href")
    ))
    nodes = items.select("category", "feed", F.explode(F.array(split)).alias("_nodes"))

    def first(tags: tuple[str, ...], value: Callable[[Column], Column]) -> Column:
        usable = F.filter("_nodes", lambda n: n["tag"].isin(*tags) & (squeeze(strip_tags(value(n))) != ""))
        return value(F.try_element_at(usable, F.lit(1)))

    def body(n: Column) -> Column:
        return n["body"]

    def link(n: Column) -> Column:
        return F.when(n["href"] != "", n["href"]).otherwise(n["body"])

    longest = F.array_sort(
        F.filter("_nodes", lambda n: n["tag"].isin(*FULLTEXT_TAGS)), lambda a, b: F.length(b["body"]) - F.length(a["body"])
    )
    flat = nodes.select(
        "category", "feed", clean_html(first(("title",), body)).alias("_title"), F.trim(first(("link",), link)).alias("url"),
        clean_html(first(SUMMARY_TAGS, body)).alias("_summary"), clean_html(body(F.try_element_at(longest, F.lit(1)))).alias("_full"),
        *[first((tag,), body).alias(f"_{tag}") for tag in DATE_TAGS],
    )
    published = parse_published(*[F.col(f"_{tag}") for tag in DATE_TAGS])
    out = flat.filter((F.coalesce("_title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")).select(
        "category", "feed", strip_aggregator_suffix(F.col("_title"), F.col("url")).alias("title"), "url",
        F.left(F.coalesce("_summary", F.lit("")), F.lit(SUMMARY_CHARS)).alias("summary"), published.alias("published"),
        F.when(F.length("_full") > FULLTEXT_MIN_CHARS, F.left("_full", F.lit(FULLTEXT_CHARS))).alias("fulltext"),
    )
    return out if cutoff is None else out.filter(F.col("published").isNull() | (F.col("published") >= cutoff))


def feed_health(fetched: DataFrame) -> DataFrame:
    """Per feed: alive with code 200 and at least one item, items seen, failures and an error.

    ``fetched``: feed, code, body, error.
    """
    items = F.regexp_count("body", F.lit("<item|<entry"))
    seen = fetched.withColumn("_items", F.coalesce(items, F.lit(0))).withColumn(
        "_alive", F.coalesce(F.col("code") == 200, F.lit(False)) & (F.col("_items") > 0)
    )
    return seen.groupBy("feed").agg(
        F.count(F.lit(1)).alias("fetches"), F.sum("_items").cast("long").alias("items"), F.count_if(~F.col("_alive")).alias("failures"),
        F.bool_or("_alive").alias("alive"), F.max(F.left("error", F.lit(80))).alias("last_error"),
    )


def write_daily(df: DataFrame, path: str, date: str = "date", force: bool = False) -> None:
    """One output per date; dates already there are left alone unless forced."""
    spark = df.sparkSession
    if not force and _exists(spark, path):
        done = spark.read.parquet(path).select(F.col(date).cast("string").alias(date)).distinct()
        df = df.join(done, df[date].cast("string") == done[date], "left_anti")
    df.write.partitionBy(date).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
