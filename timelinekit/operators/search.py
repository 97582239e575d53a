"""Lexical search over catalogs, query expansion and asset choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.functions.text import casefold, squeeze, token_set, tokens
from timelinekit.plans.layout import lookup_join
from timelinekit.session import cut_lineage

TAG_WEIGHT = 3
# Postings of a term up to which it may find candidates.
FREQUENT = 10_000


def _terms(df: DataFrame, ids: Sequence[str], text: Column, hashes: bool = False) -> DataFrame:
    words = token_set(text) if hashes else F.array_distinct(tokens(text))
    return df.select(*ids, F.explode(words).alias("term"))


def _common_lists(rows: DataFrame, by: str, named: dict[str, Column]) -> DataFrame:
    """Per id the sorted sets of its common terms that fulfil each condition."""
    return rows.groupBy(by).agg(*[F.array_sort(F.collect_set(F.when(c, F.col("term")))).alias(n) for n, c in named.items()])


def common_terms(offered: DataFrame, wanted: DataFrame, frequent: int) -> DataFrame:
    """Asked terms of more than ``frequent`` postings; a term nobody asks for is in no score and sets no assets apart."""
    counts = offered.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > frequent)
    return counts.select("term").join(wanted.select("term").distinct(), "term", "left_semi")


def _ranked(hits: DataFrame, query: str, asset: str, top: int) -> DataFrame:
    best = Window.partitionBy(query).orderBy(F.desc("score"), asset)
    return hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)


def best_matches(
    wanted: DataFrame, offered: DataFrame, query: str, asset: str, top: int, tag_weight: int, frequent: int = FREQUENT
) -> DataFrame:
    """(query, asset, tag_hits, text_hits, score, place): the ``top`` assets of each query by score, ties to the smaller asset.

    ``wanted`` has (query, term), ``offered`` (asset, term, _tag, _text). Terms of at most
    ``frequent`` postings find candidates by an equi-join. Common terms never do: they add to the
    scores of candidates already found, asset by asset. Only where the sum of their best points
    still reaches a query's last place can an asset without any rarer term come in; such assets are
    alike when they hold the same common terms, so of each kind the ``top`` smallest ids stand for
    all, and queries with the same common terms share one ranking of them. A term that stands in
    every asset and every query therefore costs what its postings cost and not their product.
    """
    weigh = tag_weight * F.col("tag_hits") + F.col("text_hits")
    sums = [F.sum("_tag").alias("tag_hits"), F.sum("_text").alias("text_hits")]
    common = cut_lineage(common_terms(offered, wanted, frequent))
    if common.isEmpty():
        hits = offered.join(wanted, "term").groupBy(query, asset).agg(*sums)
        return _ranked(hits.withColumn("score", weigh), query, asset, top)

    rare = offered.join(common, "term", "left_anti").join(wanted, "term").groupBy(query, asset).agg(*sums)
    tag, text = F.col("_tag") > 0, F.col("_text") > 0
    of_asset = cut_lineage(_common_lists(offered.join(common, "term", "left_semi"), asset, {"_tags": tag, "_texts": text}))
    of_query = cut_lineage(_common_lists(wanted.join(common, "term", "left_semi"), query, {"_asked": F.lit(True)}))
    none = F.array().cast("array<string>")
    more = lambda c: F.size(F.array_intersect(F.coalesce("_asked", none), F.coalesce(c, none)))
    found = rare.join(of_query, query, "left").join(of_asset, asset, "left").select(
        query, asset, (F.col("tag_hits") + more("_tags")).alias("tag_hits"), (F.col("text_hits") + more("_texts")).alias("text_hits")
    )
    found = cut_lineage(_ranked(found.withColumn("score", weigh), query, asset, top).drop("place"))

    last = found.groupBy(query).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_last"))
    bound = (tag_weight + 1) * F.size("_asked")
    unsure = of_query.join(last, query, "left").filter(F.col("_n").isNull() | (F.col("_n") < top) | (F.col("_last") <= bound))
    unsure = cut_lineage(unsure.select(query, "_asked"))
    kind = F.md5(F.concat(F.array_join("_tags", "\u0001"), F.lit("\u0002"), F.array_join("_texts", "\u0001")))
    kinds = of_asset.withColumn("_kind", kind)
    first = kinds.withColumn("_nth", F.row_number().over(Window.partitionBy("_kind").orderBy(asset))).filter(F.col("_nth") <= top)
    first = cut_lineage(first.drop("_nth"))
    one = cut_lineage(first.groupBy("_kind").agg(F.first("_tags").alias("_tags"), F.first("_texts").alias("_texts"), F.min(asset).alias(asset)))
    points = one.select("_kind", F.explode("_tags").alias("term"), F.lit(1).alias("_tag"), F.lit(0).alias("_text")).unionByName(
        one.select("_kind", F.explode("_texts").alias("term"), F.lit(0).alias("_tag"), F.lit(1).alias("_text"))
    )
    asked = unsure.select("_asked").distinct().select("_asked", F.explode("_asked").alias("term"))
    of_kind = points.join(asked, "term").groupBy("_asked", "_kind").agg(*sums)
    # behind ``top`` kinds with their smallest ids in front no asset of a further kind can have a place
    leading = _ranked(of_kind.withColumn("score", weigh).join(one.select("_kind", asset), "_kind"), "_asked", asset, top).drop(asset, "place")
    listed = _ranked(leading.join(first.select("_kind", asset), "_kind"), "_asked", asset, top)
    rest = unsure.join(listed.select("_asked", asset, "tag_hits", "text_hits", "score"), "_asked").select(*found.columns)
    # an asset found by a rarer term as well has its full score there
    merged = found.unionByName(rest).groupBy(query, asset).agg(F.max(F.struct("score", "tag_hits", "text_hits")).alias("_best"))
    return _ranked(merged.select(query, asset, "_best.tag_hits", "_best.text_hits", "_best.score"), query, asset, top)


def catalog_search(
    queries: DataFrame, assets: DataFrame, top: int = 5, query: str = "query_id", asset: str = "asset_id", frequent: int = FREQUENT
) -> DataFrame:
    """Best assets per query: three points per tag hit, one per description hit.

    ``queries``: query_id, query; ``assets``: asset_id, tags array, description. See ``best_matches``.
    """
    wanted = _terms(queries, [query], F.col("query"))
    tags = _terms(assets, [asset], F.array_join("tags", " ")).withColumn("_tag", F.lit(1)).withColumn("_text", F.lit(0))
    text = _terms(assets, [asset], F.col("description")).withColumn("_tag", F.lit(0)).withColumn("_text", F.lit(1))
    return best_matches(wanted, tags.unionByName(text), query, asset, top, TAG_WEIGHT, frequent)


def matched_terms(matches: DataFrame, queries: DataFrame, assets: DataFrame, query: str = "query_id", asset: str = "asset_id") -> DataFrame:
    """Which terms of the chosen (query, asset) pairs met, sorted; only those pairs are read back."""
    pairs = matches.join(queries.select(query, "query"), query).join(assets.select(asset, "tags", "description"), asset)
    wanted = F.array_distinct(tokens(F.col("query")))
    tag_terms = F.array_distinct(tokens(F.array_join("tags", " ")))
    text_terms = F.array_distinct(tokens(F.col("description")))
    return pairs.withColumn("matched_tags", F.array_sort(F.array_intersect(wanted, tag_terms))).withColumn(
        "matched_description", F.array_sort(F.array_intersect(wanted, text_terms))
    ).drop("query", "tags", "description")


def search_cards(queries: DataFrame, cards: DataFrame, top: int, frequent: int = FREQUENT) -> DataFrame:
    """Cards by number of shared terms. ``cards``: card_id, blob, tags."""
    wanted = _terms(queries, ["query_id"], F.col("query"), hashes=True)
    offered = _terms(cards, ["card_id"], F.col("blob"), hashes=True).withColumn("_tag", F.lit(0)).withColumn("_text", F.lit(1))
    return best_matches(wanted, offered, "query_id", "card_id", top, 0, frequent).select(
        "query_id", "card_id", F.col("text_hits").alias("overlap"), "place"
    )


def expand_queries(queries: DataFrame, cards: DataFrame, top: int = 3) -> DataFrame:
    """Queries with the tags of their best cards appended, first seen first, ``#`` removed."""
    best = search_cards(queries, cards, top).join(cards.select("card_id", "tags"), "card_id")
    listed = best.groupBy("query_id").agg(  # at most ``top`` rows per query
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "tags"))), lambda r: r["tags"])).alias("_tags")
    )
    bare = F.array_distinct(F.filter(F.transform("_tags", lambda t: F.regexp_replace(t, "^#+", "")), lambda t: t != ""))
    joined = queries.join(listed, "query_id", "left")
    expanded = F.concat_ws(" ", "query", F.array_join(bare, " "))
    return joined.select(
        "query_id", "query", F.when(F.coalesce(F.size(bare), F.lit(0)) > 0, expanded).otherwise(F.col("query")).alias("expanded")
    )


def recipe_search(recipes: DataFrame, query: str, text: str = "search_text", tags: str = "tags") -> DataFrame:
    """Recipes that contain the query, or every one of its words; an empty query returns all."""
    needle = " ".join(query.casefold().split())
    if not needle:
        return recipes
    blob, labels = casefold(F.col(text)), casefold(F.array_join(tags, " "))
    hit = blob.contains(needle) | labels.contains(needle)
    parts = needle.split()
    if len(parts) > 1:
        every = F.lit(True)
        for part in parts:
            every = every & blob.contains(part)
        hit = hit | every
    return recipes.filter(hit)


def resolve_assets(scenes: DataFrame, assets: DataFrame, matches: DataFrame) -> DataFrame:
    """Asset of each scene: the named one, else its best search hit, else motion as fallback.

    ``scenes``: scene_id, type, asset (nullable), brief; ``matches``: query_id = scene_id,
    asset_id, place.
    """
    named = assets.select(F.col("asset_id").alias("asset"), F.lit(True).alias("_named"))
    first = matches.filter("place = 1").select(F.col("query_id").alias("scene_id"), F.col("asset_id").alias("_found"))
    joined = lookup_join(scenes, named, ["asset"], "left").join(first, "scene_id", "left")
    library = F.col("type") == "library-broll"
    chosen = F.when(F.col("asset").isNotNull(), F.when(F.col("_named"), F.col("asset"))).otherwise(F.col("_found"))
    resolution = (
        F.when(~library, F.lit("CONFIGURED"))
        .when(F.col("asset").isNotNull() & F.col("_named").isNull(), F.lit("UNAVAILABLE"))
        .when(chosen.isNotNull(), F.lit("LIBRARY_MATCH"))
        .otherwise(F.lit("MOTION_FALLBACK"))
    )
    return joined.withColumn("resolved", F.when(library, chosen).otherwise(F.col("asset"))).withColumn("resolution", resolution).withColumn(
        "final_type", F.when(resolution == "MOTION_FALLBACK", F.lit("motion")).otherwise(F.col("type"))
    ).drop("_named", "_found")


def query_words(text: Column, limit: int = 16) -> Column:
    """The first words of a text as a search query."""
    return F.array_join(F.slice(F.split(squeeze(text), " "), 1, limit), " ")
