"""Block envelopes, lag correlation, drift and freeze shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
CORRELATION_MIN, DRIFT_MAX_PPM, DRIFT_MIN_S, DRIFT_WINDOW_S = 0.55, 1500.0, 40.0, 30.0
FREEZE_ADDED_MAX, FREEZE_JUDGED_S, AV_DRIFT_MAX_S = 0.03, 20.0, 0.25
# -------------------------------------------------------------------------------------------


def block_envelope(samples: DataFrame, keys: Sequence[str], index: str, value: str, block: int) -> DataFrame:
    """Mean absolute sample of each full block; an incomplete last block is dropped."""
    blocks = samples.groupBy(*keys, F.floor(F.col(index) / block).alias("block")).agg(
        F.avg(F.abs(F.col(value))).alias("envelope"), F.count(F.lit(1)).alias("_n")
    )
    return blocks.filter(F.col("_n") == block).select(*keys, "block", F.bround("envelope", 6).alias("envelope"))


def lag_correlation(
    left: DataFrame, right: DataFrame, keys: Sequence[str], index: str, value: str, max_lag: int, min_overlap: int,
    windows: str | None = None,
) -> DataFrame:
    """Pearson correlation of left[i] and right[i + lag] for every lag with enough overlap.

    Both series are dealt in blocks of ``max_lag`` samples; a right sample also goes to the block
    before and the block after, where left samples may reach it. That is the one shuffle of
    samples: inside a block the pairs are formed and enter partial sums at once. A lag whose side
    is constant scores -1.

    ``windows`` names an array column of ``left``: scores are then kept per label (``window``) and
    a sample counts for each of its labels, so several stretches of a series cost one pass.
    """
    keys = list(keys)
    size = max(1, max_lag)
    block = lambda at: F.floor(at / size).cast("long")
    at = F.col(index).cast("long")
    labels = F.array(F.lit(None).cast("string")) if windows is None else F.col(windows)
    sample = lambda mine, labels: F.struct(F.lit(mine).alias("mine"), at.alias("i"), F.col(value).cast("double").alias("v"), labels.alias("labels"))
    ours = left.select(*keys, block(at).alias("_b"), sample(True, labels).alias("_s"))
    reach = F.sequence(block(at - max_lag), block(at + max_lag))
    theirs = right.select(*keys, F.explode(reach).alias("_b"), sample(False, F.lit(None).cast("array<string>")).alias("_s"))
    blocks = ours.unionByName(theirs).groupBy(*keys, "_b").agg(F.collect_list("_s").alias("_all"))
    sides = blocks.select(*keys, F.filter("_all", lambda s: s["mine"]).alias("_l"), F.filter("_all", lambda s: ~s["mine"]).alias("_r"))
    each = sides.filter((F.size("_l") > 0) & (F.size("_r") > 0)).select(*keys, "_r", F.explode("_l").alias("_a"))
    pairs = each.select(*keys, "_a", F.explode("_r").alias("_b")).withColumn("lag", (F.col("_b.i") - F.col("_a.i")).cast("int"))
    near = pairs.filter(F.abs("lag") <= max_lag).select(*keys, "lag", F.col("_a.v").alias("_x"), F.col("_b.v").alias("_y"), F.explode("_a.labels").alias("window"))
    by = [*keys, "window", "lag"]
    spread = F.stddev_pop("_x") * F.stddev_pop("_y")
    scored = near.groupBy(*by).agg(F.try_divide(F.covar_pop("_x", "_y"), spread).alias("_r"), F.count(F.lit(1)).alias("overlap"))
    known = F.when(F.col("_r").isNull() | F.isnan("_r"), F.lit(-1.0)).otherwise(F.col("_r"))
    shown = [c for c in by if c != "window" or windows is not None]
    return scored.filter(F.col("overlap") >= min_overlap).select(*shown, "overlap", known.alias("correlation"))


def best_lag(scores: DataFrame, keys: Sequence[str], rate: int, exclusion: int) -> DataFrame:
    """Best lag per key (smallest lag on ties), and how far it stands above the best lag
    outside its neighbourhood."""
    each = Window.partitionBy(*keys)  # at most 2 * max_lag + 1 rows per key
    top = F.max_by(F.struct("lag", "correlation"), F.struct("correlation", -F.col("lag"))).over(each)
    ranked = scores.withColumn("_top", top)
    outside = F.max(F.when(F.abs(F.col("lag") - F.col("_top.lag")) > exclusion, F.col("correlation")))
    out = ranked.groupBy(*keys, F.col("_top.lag").alias("lag"), F.col("_top.correlation").alias("_best")).agg(outside.alias("_second"))
    return out.select(
        *keys, (F.col("lag") / rate).alias("offset_s"), F.bround("_best", 6).alias("correlation"),
        F.bround(F.col("_best") - F.coalesce("_second", F.lit(-1.0)), 6).alias("prominence"),
    )


def drift_verdict(
    whole: DataFrame, early: DataFrame, late: DataFrame, keys: Sequence[str], duration: Column, window: Column
) -> DataFrame:
    """Drift between the offsets of the first and last window, judged from 40 s on."""
    joined = (
        whole.join(early.select(*keys, F.col("offset_s").alias("early_s")), list(keys), "left")
        .join(late.select(*keys, F.col("offset_s").alias("late_s")), list(keys), "left")
        .withColumn("_d", duration).withColumn("_w", window)
    )
    ppm = F.when(
        F.col("_d") >= DRIFT_MIN_S, (F.col("late_s") - F.col("early_s")) / F.greatest(F.col("_d") - F.col("_w"), F.lit(1.0)) * 1e6
    ).otherwise(F.lit(0.0))
    reasons = F.array_compact(F.array(
        F.when(F.col("correlation") < CORRELATION_MIN, F.lit("correlation below threshold")),
        F.when(F.abs(ppm) > DRIFT_MAX_PPM, F.lit("drift exceeds threshold")),
    ))
    return joined.select(
        *keys, "offset_s", "correlation", F.bround(ppm, 3).alias("drift_ppm"), F.array_join(reasons, "; ").alias("reasons"),
        F.when(F.size(reasons) > 0, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("verdict"),
    )


def freeze_share(
    runs: DataFrame, source_runs: DataFrame, media: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Frozen share of a render minus that of its source, judged on media of 20 s or more.

    ``media``: key, duration_s, source_duration_s, video_s, audio_s.
    """
    keys = list(keys)
    frozen = runs.groupBy(*keys).agg(F.sum("duration_s").alias("_frozen"), F.max("duration_s").alias("_longest"))
    source = source_runs.groupBy(*keys).agg(F.sum("duration_s").alias("_source"))
    joined = media.join(frozen, keys, "left").join(source, keys, "left")
    share = F.coalesce(F.try_divide(F.coalesce("_frozen", F.lit(0.0)), F.col("duration_s")), F.lit(0.0))
    source_share = F.coalesce(F.try_divide(F.coalesce("_source", F.lit(0.0)), F.col("source_duration_s")), F.lit(0.0))
    judged = F.col("duration_s") >= FREEZE_JUDGED_S
    drift = F.col("video_s") - F.col("audio_s")
    apart = (F.col("video_s") > 0) & (F.col("audio_s") > 0) & (F.abs(drift) > AV_DRIFT_MAX_S)
    failed = (judged & (share - source_share > FREEZE_ADDED_MAX)) | apart
    return joined.select(
        *keys, F.bround(share, 4).alias("freeze_share"), F.bround(source_share, 4).alias("source_freeze_share"),
        F.bround(share - source_share, 4).alias("added_freeze_share"), judged.alias("judged"),
        F.bround(F.coalesce("_longest", F.lit(0.0)), 3).alias("longest_freeze_s"), F.bround(drift, 3).alias("av_drift_s"),
        F.when(failed, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("verdict"),
    )
