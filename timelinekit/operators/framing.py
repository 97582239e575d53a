"""Geometry of detections, crops and captions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelinekit.functions.text import squeeze
from timelinekit.plans.quantiles import exact_percentiles

# ---- fixed values -------------------------------------------------------------------------
HEIGHT_MIN, HEIGHT_MAX = 0.10, 0.40
ASPECT_MIN, ASPECT_MAX = 0.50, 1.60
TOP_MAX, BAND_LOW, BAND_HIGH = 0.55, 0.15, 0.85
HEIGHT_TARGET, HEADROOM_TARGET = 0.26, 0.10
LARGE_SOURCE, FILL_CAP, COVER_SLACK, CROWN = 0.18, 0.34, 1.10, 0.18
EDGE_MARGIN_PX, CENTRE_HARD, CENTRE_SOFT = 24, 0.20, 0.14
HEADROOM_MIN, HEADROOM_SOFT_MAX, HEADROOM_MAX = 0.04, 0.18, 0.40
CAPTION_GAP_RATIO, CAPTION_SAFETY_PX = 0.10, 48
BAND_TOP_RATIO, BAND_BOTTOM_RATIO = 0.60, 0.66
CAPTION_WIDTH_RATIO, CAPTION_MIN_WIDTH_PX, CAPTION_FRAME_RATIO = 2.2, 280, 0.86
FONT_RATIO, FONT_RATIO_MIN, FONT_RATIO_MAX, FONT_MIN_PX = 0.045, 0.02, 0.18, 16
HOOK_RATIO, HOOK_OVER_BODY = 0.072, 1.25
WRAP_MIN, WRAP_MAX, ADVANCE_MIN_PX, ADVANCE_EM = 8, 28, 8.0, 0.48
MIN_BOXES = 5
FORMULA = r"(\d[\d\s]*\d|\d+)\s*(?:→|->)\s*(?:[^\d]{0,24}?)(\d[\d\s]*\d|\d+)"
QUOTED = r"[«\"]([^»\"]{1,24})[»\"]"
FORMULA_WIDE = r"(\d[\d\s]*\d|\d+)\s*(?:→|->|—)\s*(?:[^\d]{0,32}?)(\d[\d\s]*\d|\d+)"
AMOUNT = r"(?iU)(\d[\d\s]*\d|\d+)\s*(?:₽|руб|р\.?)\b"
MONTHS = r"(?iU)(\d+)\s*месяц"
SCHEME = r"(?iU)\bсхема\b"
BRIEF_CLASSES = (
    ("meter_drop", ("ползёт", "ползет", "индикатор", "кошелёк", "кошелек", "на нуле"), "0 ₽"),
    ("panic_sequence", ("иконки", "паник", "горящ", "экстренн"), "паника"),
    ("bank_friction", ("два банка", "другом банке", "перевод", "трением", "замок"), "2 банка"),
)
# -------------------------------------------------------------------------------------------


def plausible_boxes(boxes: DataFrame) -> DataFrame:
    """Head-sized detections: x, y, w, h within a frame of src_w, src_h."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    ratio, aspect = h / F.col("src_h"), w / h
    sized = boxes.filter((h > 0) & (w > 0))
    return sized.filter(
        ratio.between(HEIGHT_MIN, HEIGHT_MAX) & aspect.between(ASPECT_MIN, ASPECT_MAX) & (y <= F.col("src_h") * TOP_MAX)
        & (x + w >= F.col("src_w") * BAND_LOW) & (x <= F.col("src_w") * BAND_HIGH)
    )


def box_score() -> Column:
    """Prefers mid-sized boxes near the top."""
    fill = F.col("h") / F.greatest(F.col("src_h"), F.lit(1))
    size = 1.0 - F.least(F.lit(1.0), F.abs(fill - HEIGHT_TARGET) / HEIGHT_TARGET)
    top = 1.0 - F.least(F.lit(1.0), F.col("y") / F.greatest(F.col("src_h") * 0.5, F.lit(1)))
    return size * 0.7 + top * 0.3


def representative_box(boxes: DataFrame, keys: Sequence[str], box_id: str) -> DataFrame:
    """Centre, top and height: medians from five boxes on, otherwise those of the best box;
    always the lowest edge."""
    keys = list(keys)
    sides = {"cx": F.col("x") + F.col("w") / 2, "top": F.col("y").cast("double"), "height": F.col("h").cast("double")}
    scored = boxes.withColumns({"_score": box_score(), **sides})
    out = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("boxes"), F.max_by(F.struct(*sides), F.struct("_score", -F.col(box_id))).alias("_best"),
        F.max(F.col("y") + F.col("h")).alias("bottom_max"),
    )
    for side in sides:
        out = out.join(exact_percentiles(scored, keys, side, {f"_m{side}": 0.5}).drop("n"), keys)
    return out.select(
        *keys, "boxes", *[F.when(F.col("boxes") >= MIN_BOXES, F.bround(f"_m{s}", 0).cast("long")).otherwise(F.floor(F.col(f"_best.{s}"))).alias(s) for s in sides],
        "bottom_max",
    )


def framing_plan(boxes: DataFrame, out_w: int, out_h: int) -> DataFrame:
    """Scale and crop that give the head its size and headroom without cutting it off."""
    x, y, w, h, sw, sh = (F.col(c).cast("double") for c in ("x", "y", "w", "h", "src_w", "src_h"))
    cover = F.greatest(F.lit(float(out_w)) / sw, F.lit(float(out_h)) / sh)
    crown = F.greatest(F.lit(0.0), y - CROWN * h)
    headroom = F.least(F.lit(out_h * (1.0 - HEADROOM_TARGET)) / F.greatest(F.lit(1.0), sh - crown), cover * COVER_SLACK)
    cap = F.when(h / sh >= LARGE_SOURCE, cover).otherwise(F.lit(FILL_CAP * out_h) / h)
    scale = F.least(F.greatest(cover, F.lit(HEIGHT_TARGET * out_h) / h, headroom), F.greatest(cover, cap))

    def even_up(v: Column) -> Column:
        whole = F.bround(v, 0).cast("long")
        return whole + whole % 2

    def crop(v: Column, size: Column, out: int) -> Column:
        inside = F.floor(F.least(F.greatest(F.lit(0.0), v), F.greatest(F.lit(0.0), size - out)))
        return inside - inside % 2

    plan = boxes.withColumn("scaled_w", even_up(sw * scale)).withColumn("scaled_h", even_up(sh * scale))
    scale_x, scale_y = F.col("scaled_w") / sw, F.col("scaled_h") / sh
    plan = plan.withColumn("crop_x", crop((x + w / 2) * scale_x - out_w / 2, F.col("scaled_w"), out_w)).withColumn(
        "crop_y", crop(crown * scale_y - HEADROOM_TARGET * out_h, F.col("scaled_h"), out_h)
    )
    top = y * scale_y - F.col("crop_y")
    return plan.withColumn("headroom_ratio", F.bround(top / out_h, 4)).withColumn("height_ratio", F.bround(h * scale_y / out_h, 4))


def boxes_overlap(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column) -> Column:
    return (top_b < bottom_a) & (bottom_b > top_a)


def composition_reasons(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(hard, soft) reasons about headroom, frame edges and horizontal centring of a box."""
    headroom = y / F.greatest(height, F.lit(1))
    offset = F.abs(x + w / 2 - width / 2) / F.greatest(width, F.lit(1))
    margins = {"left": x, "top": y, "right": width - (x + w), "bottom": height - (y + h)}
    hard = F.array_compact(F.array(
        F.when(headroom < HEADROOM_MIN, F.lit("headroom too small")),
        F.when(headroom > HEADROOM_MAX, F.lit("headroom extreme")),
        *[F.when(margin < EDGE_MARGIN_PX, F.lit(f"too close to the {side} edge")) for side, margin in margins.items()],
        F.when(offset > CENTRE_HARD, F.lit("off centre")),
    ))
    soft = F.array_compact(F.array(
        F.when((headroom > HEADROOM_SOFT_MAX) & (headroom <= HEADROOM_MAX), F.lit("headroom above the target band")),
        F.when((offset > CENTRE_SOFT) & (offset <= CENTRE_HARD), F.lit("drifting off centre")),
    ))
    return hard, soft


def map_box(plan: DataFrame) -> DataFrame:
    """Detection box in output pixels after scale and crop."""
    scale_x, scale_y = F.col("scaled_w") / F.col("src_w"), F.col("scaled_h") / F.col("src_h")

    def whole(v: Column) -> Column:
        return F.bround(v, 0).cast("long")

    return plan.withColumns({
        "out_x": whole(F.col("x") * scale_x - F.col("crop_x")), "out_y": whole(F.col("y") * scale_y - F.col("crop_y")),
        "out_w": F.greatest(F.lit(1).cast("long"), whole(F.col("w") * scale_x)),
        "out_h": F.greatest(F.lit(1).cast("long"), whole(F.col("h") * scale_y)),
    })


def caption_anchor(bottom: Column, w: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """(x, y, max width) of a caption: frame centre, chest band under the lowest head edge."""
    gap = F.greatest(F.lit(CAPTION_SAFETY_PX).cast("long"), F.floor(height * CAPTION_GAP_RATIO))
    band = F.least(F.greatest(bottom + gap, F.floor(height * BAND_TOP_RATIO)), F.floor(height * BAND_BOTTOM_RATIO))
    y = F.greatest(band, bottom + gap)
    y = F.when(y + 40 > height, F.greatest(F.lit(40).cast("long"), height - 80)).otherwise(y)
    margin = F.greatest(F.lit(48).cast("long"), F.floor(width * 0.12))
    x = F.least(F.greatest(margin, F.floor(width / 2)), width - margin)
    span = F.least(F.greatest(F.lit(CAPTION_MIN_WIDTH_PX).cast("long"), F.floor(w * CAPTION_WIDTH_RATIO)), F.floor(width * CAPTION_FRAME_RATIO))
    return x, y, span


def caption_sizes(height: Column, ratio: Column | None = None, width_px: Column | None = None) -> dict[str, Column]:
    """Caption and hook sizes of a frame and the characters that fit a line."""
    body = F.lit(FONT_RATIO) if ratio is None else F.greatest(F.lit(FONT_RATIO_MIN), F.least(F.lit(FONT_RATIO_MAX), F.coalesce(ratio, F.lit(FONT_RATIO))))
    font = F.greatest(F.lit(FONT_MIN_PX).cast("long"), F.bround(height * body, 0).cast("long"))
    hook = F.greatest(F.lit(HOOK_RATIO), F.bround(body * HOOK_OVER_BODY, 4))
    chars = F.lit(WRAP_MAX).cast("long")
    if width_px is not None:
        fits = F.floor(width_px / F.greatest(F.lit(ADVANCE_MIN_PX), font * ADVANCE_EM))
        chars = F.when(F.coalesce(width_px, F.lit(0)) <= 0, chars).otherwise(F.greatest(F.lit(WRAP_MIN), F.least(F.lit(WRAP_MAX), fits)).cast("long"))
    return {"font_px": font, "hook_ratio": hook, "wrap_chars": chars}


def classify_brief(brief: Column) -> tuple[Column, Column]:
    """(template class, label) by the first rule that applies."""
    text = squeeze(F.coalesce(brief, F.lit("")))
    low = F.lower(text)
    what = F.regexp_replace(F.regexp_replace(text, r"(?isU)\bзачем\s*:.*$", ""), r"^[ .]+|[ .]+$", "")

    def formula(source: Column) -> Column:
        found = []
        for pattern in (FORMULA, FORMULA_WIDE):
            left, right = squeeze(F.regexp_extract(source, pattern, 1)), squeeze(F.regexp_extract(source, pattern, 2))
            found.append(F.when(left != "", F.concat_ws(" → ", left, right)))
        return F.coalesce(*found)

    quotes = F.regexp_extract_all(what, F.lit(QUOTED), F.lit(1))
    amount = squeeze(F.regexp_extract(what, AMOUNT, 0))
    punch = F.coalesce(
        F.when(F.size(quotes) > 0, F.array_join(F.slice(quotes, 1, 2), " / ")), formula(what), F.when(amount != "", amount)
    )
    months = F.regexp_extract(text, MONTHS, 1)
    stacked = (months != "") | (
        (low.contains("складыва") | low.contains("стопка")) & (low.contains("мес") | low.contains("год"))
    )
    rules = [(formula(text).isNotNull(), "formula_split", formula(text))]
    for name, words, fallback in BRIEF_CLASSES:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        rules.append((hit, name, F.coalesce(punch, F.lit(fallback))))
    rules += [
        (stacked, "stack_growth", F.concat(F.when(months != "", months).otherwise(F.lit("12")), F.lit(" мес × 6 000"))),
        (low.contains("весы") | low.contains(" vs "), "scales_tilt", F.coalesce(punch, F.lit("приоритеты"))),
        (low.contains("сдвиг приоритет") | (low.contains("приоритет") & text.rlike(SCHEME)), "priority_shift",
         F.coalesce(punch, F.when(text.rlike(SCHEME), F.lit("схема")).otherwise(F.lit("приоритеты")))),
        (punch.isNotNull(), "text_punch", punch),
    ]
    name, label = F.lit("kinetic_accent"), F.lit("")
    for hit, kind, shown in reversed(rules):
        name, label = F.when(hit, F.lit(kind)).otherwise(name), F.when(hit, shown).otherwise(label)
    return F.when(text == "", F.lit("kinetic_accent")).otherwise(name), F.when(text == "", F.lit("")).otherwise(label)
