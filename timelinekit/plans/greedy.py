"""First-wins selection: walk rows in order, keep a row unless one of its tokens is taken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelinekit.plans.layout import lookup_join
from timelinekit.session import cut_lineage


def first_wins(df: DataFrame, row_id: str, tokens: Sequence[str], order: Sequence) -> DataFrame:
    """Rows kept by the sequential rule "drop if any token was seen on a kept row".

    All ``tokens`` columns share one namespace; ``order`` is a list of sort columns made
    total by ``row_id``. Only kept rows add tokens, so this is not ``dropDuplicates``.

    The same result is reached without a sequential pass: a row that is first on all its
    tokens is kept, every other row that shares a token with it is dropped, and the
    undecided rest repeats. Rows equal in all tokens collapse onto their first row before
    anything is joined, which is exact because later copies can never be kept. Each round is
    a minimum per token (map-side combined) and joins against tables unique per token.
    """
    rank = F.struct(*order, F.col(row_id))
    pending = cut_lineage(
        df.groupBy(*tokens).agg(F.min(rank).alias("_rank"))
        .select("_rank", F.array_distinct(F.array(*[F.col(t) for t in tokens])).alias("_tokens"))
    )
    kept = None
    while True:
        pairs = pending.select("_rank", F.explode("_tokens").alias("_token"))
        firsts = pairs.groupBy("_token").agg(F.min("_rank").alias("_first"))
        compared = lookup_join(pairs, firsts, ["_token"], "inner")
        verdict = compared.groupBy("_rank").agg(F.bool_and(F.col("_rank") == F.col("_first")).alias("_wins"))
        decided = cut_lineage(verdict.filter("_wins").select("_rank"))
        kept = decided if kept is None else kept.unionByName(decided)
        taken = pairs.join(decided, "_rank", "left_semi").select("_token", F.lit(True).alias("_taken")).distinct()
        marked = lookup_join(pairs, taken, ["_token"], "left")
        open_rows = marked.groupBy("_rank").agg(
            F.collect_set("_token").alias("_tokens"), F.count("_taken").alias("_hits")
        )
        pending = cut_lineage(open_rows.filter("_hits = 0").select("_rank", "_tokens"))
        if pending.isEmpty():
            break
    return df.join(kept.select(F.col(f"_rank.{row_id}").alias(row_id)), row_id, "left_semi")
