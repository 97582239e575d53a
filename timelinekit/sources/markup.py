"""Editable transcript markup and revision notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.functions.text import parse_timecode

# ---- fixed values -------------------------------------------------------------------------
ENTRY_HEADER = (
    r"^\[([0-9:.]+)(?: (?:->|—) ([0-9:.]+))?\] (KEEP|CUT)"
    r"(?: \(([^)]+)\)| reason=([A-Za-z0-9_.-]+))? id=([A-Za-z0-9_.-]+)"
    r"(?: words=([A-Za-z0-9_.,-]+))?\s*$"
)
SEGMENT_END = r"^\[([0-9:.]+)\] КОНЕЦ СЕГМЕНТА\s*$"
OVERLAY_HEADER = (
    r"^\[([0-9:.]+)\] (MOTION|BROLL|FOOTAGE|SCREEN|NONE) ([A-Za-z0-9]+)"
    r" \((?:оверлей-)?(начало|конец)\)(?: @([A-Za-z0-9_.-]+))?(?: asset=([A-Za-z0-9_./\\-]+))?\s*$"
)
FIX_LINE = (
    r"^- \[fix (blocking|speech|visual|audio|metadata)\] segment=([A-Za-z0-9_.-]+) "
    r"(?:range=([0-9:.]+)-([0-9:.]+) )?(.+)$"
)
RULE_LINE = r"^- \[rule candidate\] scope=(project|profile|global) (.+)$"
REASON_LABELS = {
    "маркер пересъёма": "retake-marker",
    "повтор фразы": "proposed-repetition",
    "повтор начала дубля": "proposed-retake-prefix",
    "повтор блока": "proposed-retake-block",
    "предложенный дубль": "proposed-take",
    "фальстарт": "false-start",
}
OVERLAY_TYPES = {"MOTION": "motion", "BROLL": "library-broll", "FOOTAGE": "screen", "SCREEN": "screen", "NONE": "none"}
# -------------------------------------------------------------------------------------------


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _group(line: Column, pattern: str, number: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, number), F.lit(""))


def _lines(files: DataFrame, key: str, body: str) -> DataFrame:
    return files.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw"))


def _kind(line: Column) -> Column:
    """What a line of a transcript file is."""
    overlay = line.rlike(OVERLAY_HEADER)
    # Headers start with a bracket; other lines needn't be matched with them.
    return (
        F.when(~line.startswith("["), F.when(line.startswith("#") | line.startswith("<!--"), F.lit("stop")).when(line == "", F.lit("blank")).otherwise(F.lit("text")))
        .when(line.rlike(ENTRY_HEADER), F.lit("entry"))
        .when(overlay & (_group(line, OVERLAY_HEADER, 4) == "конец"), F.lit("end")).when(overlay, F.lit("overlay"))
        .when(line.rlike(SEGMENT_END), F.lit("stop")).otherwise(F.lit("text"))
    )


def _blocks(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, _blocks): per file its blocks in order, each with its head line, body lines and body."""
    trimmed = F.transform(F.split(body, r"\r?\n"), lambda raw, i: F.struct(i.alias("line_no"), raw.alias("raw"), F.trim(raw).alias("line")))
    lines = files.select(key, F.transform(trimmed, lambda x: F.struct(x["line_no"], x["raw"], x["line"], _kind(x["line"]).alias("_kind"))).alias("_lines"))

    def opens(x: Column, i: Column) -> Column:
        # A blank line closes a block only when a body line stands before it.
        after_text = F.coalesce(F.get("_lines", i - 1)["_kind"] == "text", F.lit(False))
        return (i == 0) | x["_kind"].isin("entry", "overlay", "end", "stop") | ((x["_kind"] == "blank") & after_text)

    cut = lines.withColumn("_at", F.transform(F.filter("_lines", opens), lambda x: x["line_no"]))

    def block(at: Column, i: Column) -> Column:
        length = F.coalesce(F.get("_at", i + 1), F.size("_lines")) - at
        return F.struct(F.get("_lines", at).alias("_head"), F.filter(F.slice("_lines", at + 1, length), lambda x: x["_kind"] == "text").alias("_texts"))

    def joined(x: Column) -> Column:
        whole = F.array_join(F.transform(x["_texts"], lambda t: t["raw"]), "\n")
        return F.struct(x["_head"].alias("_head"), x["_texts"].alias("_texts"), F.regexp_replace(whole, r"(?U)^\s+|\s+$", "").alias("_body"))

    return cut.select(key, F.transform(F.transform("_at", block), joined).alias("_blocks"))


def _rejects(found: DataFrame, key: str) -> DataFrame:
    """(key, line_no, reason) of the blocks of each file."""
    def reject(line_no: Column, reason: str) -> Column:
        return F.struct(line_no.alias("line_no"), F.lit(reason).alias("reason"))

    def faults(x: Column) -> Column:
        head, empty = x["_head"], x["_body"] == ""
        return (
            F.when(~head["_kind"].isin("entry", "overlay"), F.transform(x["_texts"], lambda t: reject(t["line_no"], "text outside a block")))
            .when(empty, F.array(reject(head["line_no"], "empty block")))
            .when((head["_kind"] == "overlay") & _group(head["line"], OVERLAY_HEADER, 5).isNull(), F.array(reject(head["line_no"], "overlay without anchor")))
            .otherwise(F.array().cast("array<struct<line_no:int,reason:string>>"))
        )

    def name(x: Column) -> Column:
        head = x["_head"]
        return F.struct(_group(head["line"], OVERLAY_HEADER, 3).alias("id"), (head["_kind"] == "end").alias("ends"), head["line_no"].alias("line_no"))

    # By id, starts come before ends: an id whose first line is an end has no start.
    named = F.filter("_blocks", lambda x: (x["_head"]["_kind"] == "end") | ((x["_head"]["_kind"] == "overlay") & (x["_body"] != "")))
    listed = found.withColumn("_named", F.array_sort(F.transform(named, name)))
    alone = F.filter("_named", lambda x, i: x["ends"] & ((i == 0) | (F.get("_named", i - 1)["id"] != x["id"])))
    # As in ``parse_markup``: an inner inline would parse again for its filter.
    return listed.select(key, F.inline_outer(F.concat(
        F.flatten(F.transform("_blocks", faults)), F.transform(alone, lambda x: reject(x["line_no"], "end without start")),
    ))).filter("line_no IS NOT NULL")


def parse_markup(files: DataFrame, key: str, body: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, overlays, rejects) of transcript files, one row per file.

    A header opens a block and the lines after it are its body; blank lines (once there is a
    body), comments and other headers close it. A file's lines stay in its row; only overlay starts
    and ends move, to meet by id.
    """
    found = _blocks(files, key, body)
    # An inner inline makes Spark filter files by the size of their blocks first, which puts the steps of
    # ``_blocks`` into one another and runs them anew for each line. Rows without a block have no head.
    opened = found.select(key, F.inline_outer("_blocks"))
    blocks = opened.filter(F.col("_head._kind").isin("entry", "overlay"))
    head = F.col("_head.line")
    stamp = parse_timecode(_group(head, ENTRY_HEADER, 1))
    bold = F.regexp_extract("_body", r"(?s)^\*\*(.*)\*\*$", 1)
    speech = F.when((bold != "") & ~bold.contains("**"), F.trim(bold)).otherwise(F.col("_body"))
    reason = F.coalesce(_group(head, ENTRY_HEADER, 5), F.try_element_at(_lookup(REASON_LABELS), F.lower(_group(head, ENTRY_HEADER, 4))), _group(head, ENTRY_HEADER, 4))
    entries = blocks.filter("_head._kind = 'entry' AND _body <> ''").select(
        key, F.col("_head.line_no").alias("line_no"), _group(head, ENTRY_HEADER, 6).alias("id"), F.lower(_group(head, ENTRY_HEADER, 3)).alias("kind"),
        stamp.alias("start_s"), F.coalesce(parse_timecode(_group(head, ENTRY_HEADER, 2)), stamp).alias("end_s"), reason.alias("reason"),
        F.filter(F.split(F.coalesce(_group(head, ENTRY_HEADER, 7), F.lit("")), ","), lambda w: w != "").alias("word_ids"), speech.alias("text"),
    )
    # Starts and ends come from one pass; ends of an unknown file meet no start.
    ends = F.col("_head._kind") == "end"
    marks = opened.filter(ends | ((F.col("_head._kind") == "overlay") & (F.col("_body") != "") & _group(head, OVERLAY_HEADER, 5).isNotNull())).select(
        key, F.col("_head.line_no").alias("line_no"), _group(head, OVERLAY_HEADER, 3).alias("overlay_id"), _group(head, OVERLAY_HEADER, 5).alias("anchor"),
        F.try_element_at(_lookup(OVERLAY_TYPES), _group(head, OVERLAY_HEADER, 2)).alias("type"), parse_timecode(_group(head, OVERLAY_HEADER, 1)).alias("start_s"),
        _group(head, OVERLAY_HEADER, 6).alias("asset"), F.regexp_replace("_body", r"^\(поверх речи.*?\) ", "").alias("brief"), ends.alias("_ends"),
        F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("_alone"),
    )
    end_s = F.max_by("start_s", F.when(F.col("_ends") & F.col(key).isNotNull(), F.col("line_no"))).over(Window.partitionBy(key, "overlay_id", "_alone"))
    overlays = marks.withColumn("end_s", end_s).filter(~F.col("_ends")).select(
        key, "overlay_id", "line_no", "anchor", "type", "start_s", "asset", "brief", "end_s"
    )
    return entries, overlays, _rejects(found, key)


def parse_notes(files: DataFrame, key: str, body: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fixes, rule candidates, rejects) of revision notes; ids count within their file."""
    line = F.col("line")
    lines = _lines(files, key, body).filter((line != "") & ~line.startswith("#"))
    start, end = parse_timecode(_group(line, FIX_LINE, 3)), parse_timecode(_group(line, FIX_LINE, 4))
    fixes = lines.filter(line.rlike(FIX_LINE)).select(
        key, "line_no", F.format_string("fix-%03d", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).alias("id"),
        _group(line, FIX_LINE, 1).alias("kind"), _group(line, FIX_LINE, 2).alias("segment_id"), start.alias("start_s"), end.alias("end_s"),
        _group(line, FIX_LINE, 5).alias("description"), (_group(line, FIX_LINE, 1) == "blocking").alias("blocking"),
    )
    rules = lines.filter(line.rlike(RULE_LINE) & ~line.rlike(FIX_LINE)).select(
        key, "line_no", F.format_string("rule-%03d", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).alias("id"),
        _group(line, RULE_LINE, 1).alias("scope"), _group(line, RULE_LINE, 2).alias("description"),
    )
    unknown = lines.filter(~line.rlike(FIX_LINE) & ~line.rlike(RULE_LINE)).select(key, "line_no", F.lit("unknown line").alias("reason"))
    reversed_ = fixes.filter(F.col("end_s") <= F.col("start_s")).select(key, "line_no", F.lit("reversed range").alias("reason"))
    return fixes.filter(~F.coalesce(F.col("end_s") <= F.col("start_s"), F.lit(False))), rules, unknown.unionByName(reversed_)
