"""Candidate selection: recency, junk rules, first-wins dedup, scored pools and balance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.functions.text import title_key
from timelinekit.plans.greedy import first_wins

# ---- fixed values -------------------------------------------------------------------------
RECENT_HOURS = 30
TITLE_MIN_CHARS = 25
JUNK_TITLE = (
    r"подвел[аи]? (финансовые )?итоги|подвёл итоги|запустил[аи]? 4G|"
    r"стали чаще (искать|покупать)|партнерск\w+ фулфилмент|вебинар|"
    r"назначен\w* (на пост|директором)|открыл[аи]? офис|"
    r"приглашает|стартовал приём заявок|дарит|скидк"
)
JUNK_URL = r"cnews\.ru/news/line/|/promo/|/reklama/"
TOPIC_WORDS = (
    r"\bии\b|\bai\b|нейросет|искусственн\w+ интеллект|llm|gpt|chatgpt|"
    r"claude|нейронн\w+ сет|машинн\w+ обучен|ml[- ]"
)
POOL = 40
# -------------------------------------------------------------------------------------------


def recent(df: DataFrame, now: Column, hours: int = RECENT_HOURS, ts: str = "published") -> DataFrame:
    """Rows without a time stay; others must not be older than ``hours``."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours))))


def junk_filter(df: DataFrame) -> DataFrame:
    return df.filter(
        (F.length("title") >= TITLE_MIN_CHARS)
        & ~F.col("title").rlike(f"(?iU){JUNK_TITLE}")
        & ~F.col("url").rlike(JUNK_URL)
    )


def topic_flag(case: Column, title: Column, topic: Column) -> Column:
    text = F.concat_ws(" ", title, F.coalesce(topic, F.lit("")))
    return F.coalesce(case, F.lit(False)) | text.rlike(f"(?iU){TOPIC_WORDS}")


def dedup_first_wins(df: DataFrame, row_id: str) -> DataFrame:
    """Newest first, rows without a time last; a title key or url blocks later rows only when
    it belongs to a row that was kept."""
    keyed = df.withColumn("_key", title_key(F.col("title"))).withColumn("_url", F.col("url"))
    newest = [F.col("published").isNull(), -F.unix_micros(F.col("published").cast("timestamp"))]
    return first_wins(keyed, row_id, ["_key", "_url"], newest).drop("_key", "_url")


def by_rank(row_id: str) -> list[Column]:
    """Selection order: best score first, then oldest, rows without a time before all others."""
    return [F.coalesce("score", F.lit(0)).desc(), F.col("published").asc_nulls_first(), F.col(row_id).asc()]


def quota_pool(df: DataFrame, row_id: str, pool: int = POOL) -> DataFrame:
    """Three fifths of the pool for cases, the rest for others; each side is a distributed top-k."""
    quota = pool * 3 // 5
    is_case = F.coalesce(F.col("case"), F.lit(False))
    cases = df.filter(is_case).orderBy(*by_rank(row_id)).limit(quota)
    others = df.filter(~is_case).orderBy(*by_rank(row_id)).limit(pool - quota)
    return cases.unionByName(others)


def balance(df: DataFrame, keys: list[str], position: str, flag: str, take: int, ceiling: int) -> DataFrame:
    """Send flagged rows over ``ceiling`` and rows beyond ``take`` to the tail.

    ``slot`` numbers the result. A row is eligible when it is not flagged or among the first
    ``ceiling`` flagged ones; the first ``take`` eligible rows form the main part, free
    places are refilled from the tail in order. Apply it to issues (already cut to a pool),
    which is what bounds the rows of a key.
    """
    each = Window.partitionBy(*keys)
    running = each.orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = F.sum(F.col(flag).cast("int")).over(running)
    eligible = (~F.col(flag)) | (F.col("_flagged") <= ceiling)
    ranked = df.withColumn("_flagged", flagged).withColumn("_eligible", eligible)
    ranked = ranked.withColumn("_nth", F.sum(F.col("_eligible").cast("int")).over(running))
    ranked = ranked.withColumn("_tail", ~(F.col("_eligible") & (F.col("_nth") <= take)))
    placed = ranked.withColumn("slot", F.row_number().over(each.orderBy("_tail", position)))
    return placed.withColumn("main", F.col("slot") <= take).drop("_flagged", "_eligible", "_nth", "_tail")


def fill_from_reserve(df: DataFrame, keys: list[str], position: str, ok: Column, take: int) -> DataFrame:
    """First ``take`` usable rows per key in order (Spark limits each task before the shuffle)."""
    ranked = df.filter(ok).withColumn("card", F.row_number().over(Window.partitionBy(*keys).orderBy(position)))
    return ranked.filter(F.col("card") <= take)


def selection_report(df: DataFrame, keys: list[str]) -> DataFrame:
    score = F.coalesce(F.col("score"), F.lit(0))
    case = F.coalesce(F.col("case"), F.lit(False))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(score >= 3).alias("top_score"),
        F.count_if(score == 2).alias("second_score"),
        F.count_if(case).alias("cases"),
        F.count_if(~case).alias("others"),
    )


def score_batch(
    df: DataFrame, scorer: Callable[[pd.DataFrame], list[dict]], schema: str, batch: int = 50
) -> DataFrame:
    """Call ``scorer`` on batches of rows inside the tasks.

    It returns dicts with ``n`` (row number in the batch) and the new columns. A failing call
    keeps its rows with nulls; numbers outside the batch are ignored.
    """
    added = [f.strip().split()[0] for f in schema.split(",")]
    target = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [schema])

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for at in range(0, len(chunk), batch):
                part = chunk.iloc[at:at + batch].reset_index(drop=True)
                values = {name: [None] * len(part) for name in added}
                try:
                    replies = scorer(part)
                except Exception:  # the rule: a failed batch stays, unscored
                    replies = []
                for reply in replies:
                    n = int(reply["n"])
                    if 0 <= n < len(part):
                        for name in added:
                            values[name][n] = reply.get(name)
                yield part.assign(**{name: pd.Series(v, dtype="object") for name, v in values.items()})

    return df.mapInPandas(run, schema=target)
