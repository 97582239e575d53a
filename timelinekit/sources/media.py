"""Transcripts, sample series and media files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelinekit.functions.text import bound

# ---- fixed values -------------------------------------------------------------------------
WORD_SLACK_S, REVERSED_SLACK_S, MIN_WORD_S = 0.75, 0.1, 0.0001
SCREEN_NAMES = ("screen", "screencast", "desktop")
AUDIO_NAMES = ("mic", "audio", "wav", "lav", "boom")
TRANSCRIPT_SCHEMA = (
    "struct<segments: array<struct<id: string, start: double, end: double, text: string, decision: string, reason: string, "
    "take_group: string, words: array<struct<word: string, start: double, end: double, confidence: double>>>>>"
)
SERIES_SCHEMA = (
    "array<struct<t: double, framediff: double, scale: double, inliers: int, text_area: double, text_iou: double, split: double, "
    "sat: double, val: double, face: struct<cx_pct: double, cy_pct: double, h_pct: double, eye_pct: double, chin_pct: double>, "
    "cap: struct<top_pct: double, bot_pct: double, w_pct: double, glyph_pct: double, color: string, lines: int>>>"
)
# -------------------------------------------------------------------------------------------


def explode_transcripts(payloads: DataFrame, key: str, body: str, digits: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(utterances, words, rejects) of recognition payloads, one JSON text per recording.

    Missing words are spread evenly over their segment; word times are clamped to it. A
    recording with any impossible segment or word is rejected as a whole, with its reason.
    """
    parsed = payloads.select(key, F.from_json(body, TRANSCRIPT_SCHEMA).alias("_p"))
    segments = parsed.select(key, F.posexplode_outer("_p.segments").alias("seg_no", "_s")).select(
        key, "seg_no", F.col("_s").isNull().alias("_none"), F.col("_s.start").alias("_ss"), F.col("_s.end").alias("_se"), F.trim("_s.text").alias("text"),
        F.col("_s.words").alias("_given"), F.col("_s.id").alias("_id"), F.coalesce("_s.decision", F.lit("keep")).alias("decision"),
        F.col("_s.reason").alias("reason"), F.col("_s.take_group").alias("take_group"),
    )
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    start, end = F.col("_ss"), F.col("_se")

    def evenly(ts: Column) -> Column:
        step = (end - start) / F.greatest(F.size(ts), F.lit(1))
        return F.transform(ts, lambda t, i: F.struct(
            t.alias("word"), (start + i * step).alias("start"), (start + (i + 1) * step).alias("end"), F.lit(1.0).alias("confidence")
        ))

    listed = segments.withColumn(
        "_words", F.when(F.coalesce(F.size("_given"), F.lit(0)) > 0, F.col("_given")).otherwise(bound(tokens, evenly))
    )
    bad_segment = (
        F.col("_none") | start.isNull() | end.isNull() | (end <= start) | (F.col("text") == "")
        | (start < F.coalesce(F.col("_before"), F.lit(0.0)) - 1e-6)
    )
    bad_word = F.exists("_words", lambda w: (
        F.isnan(w["start"]) | F.isnan(w["end"]) | (w["end"] < w["start"] - REVERSED_SLACK_S) | (w["start"] < start - WORD_SLACK_S)
        | (w["end"] > end + WORD_SLACK_S) | (F.trim(w["word"]) == "")
    ))
    # One recording is one input row, so windows over it stay within what one task read. Words are
    # judged before them: who asks for the rejects alone sorts no words.
    in_order = Window.partitionBy(key).orderBy("seg_no")
    judged = listed.withColumn("_bad_word", F.coalesce(bad_word, F.lit(False))).withColumn("_before", F.lag(end).over(in_order)).withColumn(
        "_reason", F.when(F.coalesce(bad_segment, F.lit(True)), F.lit("invalid segment")).when(F.col("_bad_word"), F.lit("invalid word timing"))
    )
    faults = judged.filter("_reason IS NOT NULL").groupBy(key).agg(
        F.min_by("_reason", "seg_no").alias("reason"), (F.min("seg_no") + 1).alias("segment_no")
    )
    # The same pass over a recording says whether it is sound; a join would read and parse all payloads twice.
    sound = judged.withColumn("_faults", F.count("_reason").over(Window.partitionBy(key))).filter("_faults = 0")
    flat = sound.select(key, "seg_no", "_ss", "_se", F.posexplode("_words").alias("_wno", "_w")).select(
        key, "seg_no", "_ss", "_se", "_wno", F.col("_w.start").alias("_ws"), F.col("_w.end").alias("_we"), F.col("_w.word").alias("_word"),
        F.coalesce("_w.confidence", F.lit(1.0)).alias("confidence"),
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("seg_no", "_wno"))
    clamped_start = F.greatest(F.col("_ss"), F.least(F.col("_ws"), F.col("_se") - MIN_WORD_S))
    clamped_end = F.least(F.col("_se"), F.greatest(F.col("_we"), clamped_start + MIN_WORD_S))
    words = flat.select(
        key, "seg_no", F.format_string("w%06d", number).alias("word_id"), F.bround(clamped_start, digits).alias("start_s"),
        F.bround(clamped_end, digits).alias("end_s"), F.trim("_word").alias("text"), "confidence",
    )
    utterances = sound.select(
        key, "seg_no", F.coalesce("_id", F.format_string("u%04d", F.col("seg_no") + 1)).alias("id"), start.alias("start_s"),
        end.alias("end_s"), "text", F.size("_words").alias("word_count"), "decision", "reason", "take_group",
    )
    return utterances, words, faults


def segment_words(elements: DataFrame, key: str, gap_s: float = 0.6, max_s: float = 15.0) -> DataFrame:
    """Utterances of a recogniser's element list: ``elements`` has key and an array of
    (kind, value, start_s, end_s, monologue); a recording is one row.

    Punctuation sticks to the word before it. A new utterance starts after a long gap inside a
    monologue, or when the running one would last too long. Gaps cut the words into runs; the
    length rule depends on where an utterance began and is a fold over the runs that need it.
    """
    rows = elements.select(key, F.posexplode("elements").alias("_at", "_e")).select(
        key, "_at", F.col("_e.kind").alias("kind"), F.trim("_e.value").alias("value"), F.col("_e.start_s").alias("start_s"),
        F.col("_e.end_s").alias("end_s"), F.col("_e.monologue").alias("monologue"),
    )
    is_word = (F.col("kind") == "text") & (F.col("end_s") > F.col("start_s"))
    rows = rows.filter((F.col("value") != "") & (is_word | (F.col("kind") == "punct")))
    order = Window.partitionBy(key).orderBy("_at")
    numbered = rows.withColumn("_word", F.sum(is_word.cast("int")).over(order)).filter("_word > 0")
    words = numbered.groupBy(key, "_word").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda r: r["value"]), "").alias("word"),
        F.max("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("monologue").alias("monologue"),
    )
    by_word = Window.partitionBy(key).orderBy("_word")
    gap = F.when(F.lag("monologue").over(by_word) == F.col("monologue"), F.col("start_s") - F.lag("end_s").over(by_word))
    opened = words.withColumn("_opens", (F.coalesce(gap, F.lit(0.0)) >= gap_s).cast("int"))
    runs = opened.withColumn("_run", F.sum("_opens").over(by_word)).groupBy(key, "_run").agg(
        F.array_sort(F.collect_list(F.struct("_word", "start_s", "end_s", "word"))).alias("_words")
    )
    first = F.struct(F.col("_words")[0]["start_s"].alias("opened"), F.array().cast("array<bigint>").alias("heads"))

    def step(acc: Column, w: Column) -> Column:
        late = w["end_s"] - acc["opened"] > max_s
        return F.when(late, F.struct(w["start_s"].alias("opened"), F.array_append(acc["heads"], w["_word"]).alias("heads"))).otherwise(acc)

    # Heads: numbers of the words that open a further utterance inside the run.
    heads = F.when(
        F.col("_words")[F.size("_words") - 1]["end_s"] - F.col("_words")[0]["start_s"] > max_s,
        F.aggregate(F.slice("_words", 2, F.size("_words")), first, step, lambda acc: acc["heads"]),
    ).otherwise(F.array().cast("array<bigint>"))
    # Words of a run are numbered without holes, so an utterance is a slice of them.
    begun = F.col("_words")[0]["_word"]
    cut = runs.withColumn("_heads", heads).withColumn("_from", F.concat(F.array(begun), "_heads")).withColumn(
        "_until", F.concat("_heads", F.array(begun + F.size("_words")))
    )
    parts = F.transform("_from", lambda n, i: F.slice("_words", (n - begun + 1).cast("int"), (F.col("_until")[i] - n).cast("int")))
    spoken = cut.select(key, "_run", F.posexplode(parts).alias("_part", "_p")).select(
        key, "_run", "_part", F.array_min(F.transform("_p", lambda w: w["start_s"])).alias("start_s"),
        F.array_max(F.transform("_p", lambda w: w["end_s"])).alias("end_s"), F.size("_p").cast("long").alias("words"),
        F.array_join(F.transform("_p", lambda w: w["word"]), " ").alias("text"),
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("_run", "_part"))
    return spoken.select(key, number.alias("utterance"), "start_s", "end_s", "words", "text")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Sample arrays, one JSON file per clip, as rows keyed by file name; absent groups are null structs."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_f"), F.from_json("value", SERIES_SCHEMA).alias("_a"))
    clip = F.regexp_extract("_f", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return raw.select(clip.alias("clip"), F.posexplode("_a").alias("sample_no", "_r")).select("clip", "sample_no", "_r.*")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Hash, size, segment number and role of each media file under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return describe_files(files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes")))


def describe_files(files: DataFrame) -> DataFrame:
    """Add id, segment number and role from the name. ``files``: name, sha256, size_bytes."""
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    parts = F.split(stem, r"[._ -]+")

    def any_of(names: Sequence[str]):
        return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))

    role = F.when(any_of(SCREEN_NAMES), F.lit("screen")).when(any_of(AUDIO_NAMES), F.lit("audio")).otherwise(F.lit("camera"))
    number = F.nullif(F.regexp_extract("name", r"^(\d{1,4})(?:[._ -]|$)", 1), F.lit("")).try_cast("int")
    return files.withColumns({"id": F.concat(F.lit("media-"), F.left("sha256", F.lit(16))), "segment_number": number, "role": role})


def inventory_faults(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fault, detail): repeated content, unnumbered files, repeated roles, number gaps,
    segments without video."""
    keys = list(keys)

    def fault(df: DataFrame, name: str, detail) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("fault"), detail.cast("string").alias("detail"))

    content = files.groupBy(*keys, "sha256").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    unnamed = files.filter("segment_number IS NULL")
    numbered = files.filter("segment_number IS NOT NULL")
    roles = numbered.groupBy(*keys, "segment_number", "role").agg(F.count(F.lit(1)).alias("_n"))
    segments = roles.groupBy(*keys, "segment_number").agg(F.bool_or(F.col("role").isin("camera", "screen")).alias("_video"))
    spans = segments.groupBy(*keys).agg(
        F.min("segment_number").alias("_lo"), F.max("segment_number").alias("_hi"), F.count(F.lit(1)).alias("_n")
    ).filter("_hi - _lo + 1 <> _n")
    return (
        fault(content, "duplicate content", F.col("sha256"))
        .unionByName(fault(unnamed, "no segment number", F.col("name")))
        .unionByName(fault(roles.filter("_n > 1"), "duplicate role", F.concat_ws(" ", "segment_number", "role")))
        .unionByName(fault(spans, "number gap", F.concat_ws("-", "_lo", "_hi")))
        .unionByName(fault(segments.filter("NOT _video"), "no video", F.col("segment_number")))
    )
