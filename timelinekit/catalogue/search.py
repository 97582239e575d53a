"""Search queries: parts are catalog assets, their distinct names the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelinekit.catalogue.standins import table
from timelinekit.operators import search as se

QUERIES, SQL = {}, {}


def _q(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_TOK = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_'']+'))"
_TOKH = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_''#]+'))"


def _assets(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("asset_id"), F.split("p_name", " ").alias("tags"),
        F.concat_ws(" ", "p_type", "p_brand", F.when(F.col("p_size") % 3 == 0, F.col("p_name"))).alias("description"),
    )


_ASSETS = """(SELECT p_partkey AS asset_id, p_name AS tags, concat_ws(' ', p_type, p_brand, CASE WHEN p_size % 3 = 0 THEN p_name END) AS description FROM part)"""


def _names(spark, sf):
    parts = table(spark, sf, "part")
    return parts.select(F.concat_ws(" ", "p_name", "p_type").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("query")).distinct()


_NAMES = "(SELECT DISTINCT p_name || ' ' || p_type AS query_id, p_name || ' ' || p_type AS query FROM part)"

_SEARCH = f"""(SELECT query_id, asset_id, tag_hits, text_hits, 3 * tag_hits + text_hits AS score, row_number() OVER (PARTITION BY query_id ORDER BY 3 * tag_hits + text_hits DESC, asset_id) AS place FROM (
  SELECT query_id, asset_id, CAST(sum(t) AS BIGINT) AS tag_hits, CAST(sum(d) AS BIGINT) AS text_hits FROM (
    SELECT asset_id, unnest({_TOK.format('tags')}) AS term, 1 AS t, 0 AS d FROM {_ASSETS} a UNION ALL SELECT asset_id, unnest({_TOK.format('description')}), 0, 1 FROM {_ASSETS} b) x
  JOIN (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM {_NAMES} n) q ON x.term = q.term GROUP BY ALL) QUALIFY place <= 5)"""


@_q("catalog_search", f"SELECT * FROM {_SEARCH} s")
def _(spark, sf):
    return se.catalog_search(_names(spark, sf), _assets(spark, sf))


@_q("matched_terms", f"""SELECT query_id, s.asset_id, array_to_string(list_sort(list_intersect({_TOK.format('query_id')}, {_TOK.format('tags')})), ' ') AS matched_tags,
  array_to_string(list_sort(list_intersect({_TOK.format('query_id')}, {_TOK.format('description')})), ' ') AS matched_description
FROM {_SEARCH} s JOIN {_ASSETS} a ON s.asset_id = a.asset_id""")
def _(spark, sf):
    names, assets = _names(spark, sf), _assets(spark, sf)
    out = se.matched_terms(se.catalog_search(names, assets), names, assets)
    return out.select("query_id", "asset_id", F.array_join("matched_tags", " ").alias("matched_tags"), F.array_join("matched_description", " ").alias("matched_description"))


def _cards(spark, sf):
    return table(spark, sf, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("card_id")).agg(
        F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("blob"),
        F.array_sort(F.collect_set(F.concat(F.lit("#"), F.split_part("p_name", F.lit(" "), F.lit(2))))).alias("tags"),
    )


_CARDS = """(SELECT p_brand || '/' || p_type AS card_id, array_to_string(list_sort(list(DISTINCT p_name)), ' ') AS blob,
  list_sort(list(DISTINCT '#' || split_part(p_name, ' ', 2))) AS tags FROM part GROUP BY 1)"""
_CARD_HITS = f"""(SELECT query_id, card_id, overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, card_id) AS place FROM (
  SELECT query_id, card_id, count(*) AS overlap FROM (SELECT card_id, unnest({_TOKH.format('blob')}) AS term FROM {_CARDS} c) x
  JOIN (SELECT query_id, unnest({_TOKH.format('query')}) AS term FROM {_NAMES} n) q ON x.term = q.term GROUP BY ALL)) WHERE place <= 3)"""


@_q("search_cards", f"SELECT * FROM {_CARD_HITS} h")
def _(spark, sf):
    return se.search_cards(_names(spark, sf), _cards(spark, sf), 3)


@_q("expand_queries", f"""SELECT n.query_id, n.query, CASE WHEN len(t) > 0 THEN n.query || ' ' || array_to_string(t, ' ') ELSE n.query END AS expanded FROM {_NAMES} n LEFT JOIN (
  SELECT query_id, list_transform(list_sort(list_transform(list_distinct(tags), lambda x: {{'p': list_position(tags, x), 't': x}})), lambda r: r.t) AS t FROM (
    SELECT query_id, flatten(list(list_transform(tags, lambda x: ltrim(x, '#')) ORDER BY place)) AS tags FROM {_CARD_HITS} h JOIN {_CARDS} c ON h.card_id = c.card_id GROUP BY query_id)) e ON n.query_id = e.query_id""")
def _(spark, sf):
    return se.expand_queries(_names(spark, sf), _cards(spark, sf))


@_q("recipe_search", """SELECT doc_id FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), 'of the') OR contains(lower(lang || ' ' || source), 'of the')
  OR (contains(replace(lower(text), 'ß', 'ss'), 'of') AND contains(replace(lower(text), 'ß', 'ss'), 'the'))""")
def _(spark, sf):
    recipes = table(spark, sf, "documents").select("doc_id", F.col("text").alias("search_text"), F.array("lang", "source").alias("tags"))
    return se.recipe_search(recipes, "Of  the").select("doc_id")


_SCENES = """(SELECT DISTINCT p_name || ' ' || p_type AS scene_id, CASE WHEN length(p_name) % 4 = 0 THEN 'motion' ELSE 'library-broll' END AS type,
  CASE WHEN length(p_name) % 5 = 0 THEN CAST(length(p_name) * 400 AS BIGINT) END AS asset FROM part)"""


@_q("resolve_assets", f"""SELECT s.scene_id, CASE WHEN type = 'library-broll' THEN CASE WHEN s.asset IS NOT NULL THEN a.asset_id ELSE f.asset_id END ELSE s.asset END AS resolved,
  CASE WHEN type <> 'library-broll' THEN 'CONFIGURED' WHEN s.asset IS NOT NULL AND a.asset_id IS NULL THEN 'UNAVAILABLE'
    WHEN coalesce(CASE WHEN s.asset IS NOT NULL THEN a.asset_id END, CASE WHEN s.asset IS NULL THEN f.asset_id END) IS NOT NULL THEN 'LIBRARY_MATCH' ELSE 'MOTION_FALLBACK' END AS resolution
FROM {_SCENES} s LEFT JOIN {_ASSETS} a ON s.asset = a.asset_id LEFT JOIN (SELECT * FROM {_SEARCH} x WHERE place = 1) f ON s.scene_id = f.query_id""")
def _(spark, sf):
    names, assets = _names(spark, sf), _assets(spark, sf)
    scenes = names.select(
        F.col("query_id").alias("scene_id"),
        F.when(F.length(F.element_at(F.split("query", r" [A-Z]+$"), 1)) % 4 == 0, F.lit("motion")).otherwise(F.lit("library-broll")).alias("type"),
        F.when(F.length(F.element_at(F.split("query", r" [A-Z]+$"), 1)) % 5 == 0,
               (F.length(F.element_at(F.split("query", r" [A-Z]+$"), 1)) * 400).cast("long")).alias("asset"),
    )
    out = se.resolve_assets(scenes, assets, se.catalog_search(names, assets))
    return out.select("scene_id", "resolved", "resolution")
