"""Digests of ordered members of any number, without a buffer that holds them all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelinekit.plans.layout import KeyLayout
from timelinekit.plans.ordered import ordered_scan
from timelinekit.session import cut_lineage

CHUNK = 1_000


def tree_digest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, chunk: int = CHUNK, levels: int | None = None) -> DataFrame:
    """(keys, members, digest): the SHA-256 of the JSON list of a key's items in order.

    ``item`` is the JSON text of a row; ``order`` is total. Up to ``chunk`` items are one list. More
    are cut into lists of ``chunk``, whose digests form a list again, and so on; so an item meets at
    most ``chunk`` others in any task, and the digest depends on the order alone. ``levels`` ends this:
    the lists of that level hold all that is left (of two levels: a digest for each ``chunk`` items).
    """
    keys = list(keys)
    level = rows.select(*keys, *order, item.alias("_item"))
    numbered = ordered_scan(level, KeyLayout.measure(level, keys, order[0]), list(order), number="_n")
    level = numbered.select(*keys, (F.col("_n") - 1).alias("_n"), "_item", F.lit(1).cast("long").alias("_members"))
    done, height = [], 0
    while True:
        height += 1
        part = F.lit(0).cast("long") if height == levels else F.floor(F.col("_n") / chunk)
        listed = level.groupBy(*keys, part.alias("_chunk")).agg(
            F.array_sort(F.collect_list(F.struct("_n", "_item"))).alias("_items"), F.sum("_members").alias("_members")
        )
        text = F.concat(F.lit("["), F.array_join(F.transform("_items", lambda i: i["_item"]), ","), F.lit("]"))
        folded = cut_lineage(listed.select(*keys, F.col("_chunk").alias("_n"), F.sha2(text, 256).alias("_digest"), "_members"))
        several = cut_lineage(folded.filter("_n > 0").select(*keys).distinct())
        done.append(folded.join(several, keys, "left_anti").select(*keys, F.col("_members").alias("members"), F.col("_digest").alias("digest")))
        if several.isEmpty():
            return reduce(DataFrame.unionByName, done)
        quoted = F.concat(F.lit('"'), "_digest", F.lit('"'))
        level = folded.join(several, keys, "left_semi").select(*keys, "_n", quoted.alias("_item"), "_members")
