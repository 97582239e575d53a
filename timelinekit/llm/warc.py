"""Web archives in Zstandard files.

An archive starts with a skippable frame that holds the dictionary (itself perhaps a Zstandard
frame), followed by one frame per record. ``write_archives`` makes one archive per partition,
``read_archives`` loads the dictionary, decodes frame by frame and checks version, required
headers, lengths and digests.

Defined cases: a null payload counts as empty; rows with the smallest page id of their payload
are responses, all others with that payload revisit it (a null id only answers when no row of
the payload has an id); control characters of a url are percent-encoded and a null url gives no
target header; a damaged record gives a row with ``error`` set; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelinekit.llm.common import map_batches, read_raw, saved, shared_path, write_raw

# fixed values: frame magics of the archive format; the separator is an empty skippable frame,
# which every reader of the format passes over
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
WARC_DATE = "2024-01-01T00:00:00Z"

SALTS = 16
DICTIONARY_BYTES = 32_768
TRAIN_RECORDS = 256
TRAIN_BYTES = 4_000_000


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = _digest(payload)
    head = HTTP_HEAD % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and block of one record; raises ``ValueError`` when the record breaks the format."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no end of headers")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z0-9!#$%&'*+.^_`|~-]+", name):
            raise ValueError("malformed header line")
        headers[name.lower()] = value.strip()
    missing = [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in headers]
    if missing:
        raise ValueError(f"no header {missing[0]}")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise ValueError("content length is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("length of the block differs from its header")
    block = rest[:length]
    if headers.get("warc-block-digest", "").removeprefix("sha1:") not in ("", _digest(block)):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        if headers.get("warc-payload-digest", "").removeprefix("sha1:") not in ("", _digest(payload)):
            raise ValueError("payload digest differs")
        said = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
        if said and int(said[1]) != len(payload):
            raise ValueError("payload length differs from its header")
    return {"headers": headers, "payload": payload}


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from an archive's own first records; empty when they are too few to train on."""
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(content: bytes):
    """The decoded bytes of every frame, or a ``ValueError`` for one that can't be decoded.

    Input goes to the decoder in slices of 64 KB, so finding a frame's end costs its own length.
    """
    view, at, context = memoryview(content), 0, zstandard.ZstdDecompressor()
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            yield ValueError("dictionary frame is cut off")
            return
        data = content[8 : 8 + size]
        if data[:4] == struct.pack("<I", FRAME_MAGIC):
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        at = 8 + size
    while at < len(content):
        magic = struct.unpack_from("<I", content, at)[0] if at + 4 <= len(content) else 0
        if magic in SKIPPABLE and at + 8 <= len(content):
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        if magic != FRAME_MAGIC:
            yield ValueError(f"no frame at byte {at}")
            return
        decoder, out, start = context.decompressobj(), [], at
        try:
            while not decoder.eof and at < len(content):
                piece = view[at : at + 65_536]
                out.append(decoder.decompress(piece))
                at += len(piece) - len(decoder.unused_data)
        except zstandard.ZstdError as error:
            yield ValueError(f"frame at byte {start}: {error}")
            return
        if not decoder.eof:
            yield ValueError(f"frame at byte {start} is cut off")
            return
        yield b"".join(out)


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> str:
    """Write a record per row of (page_id, url, html); returns the folder of archives.

    Equal payloads are found by digest: a partial aggregate gives the smallest id of each
    repeated digest, and only those digests are joined back, on a salted key, so that a payload
    held by a third of all rows is spread over ``SALTS`` tasks per digest.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    keyed = rows.withColumn("digest", F.sha1("html"))
    repeated = (
        keyed.filter(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("shared"))
    )
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    planned = salted.join(repeated, ["digest", "salt"], "left").select(
        "page_id", "url", "html", "first",
        (F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
    )

    def work(batches):
        waiting, held, compressor = [], 0, None

        def start():
            data = train_dictionary(waiting)
            frames_out = [struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data] if data else []
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
            return packer, frames_out + [packer.compress(r) for r in waiting]

        for batch in batches:
            records = [
                record(p, u, h.encode(), f, r)
                for p, u, h, f, r in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "first", "revisit")))
            ]
            if compressor is None:
                waiting += records
                held += sum(map(len, records))
                if len(waiting) < TRAIN_RECORDS and held < TRAIN_BYTES:
                    continue
                compressor, done = start()
                waiting = []
                yield {"frame": done}
            else:
                yield {"frame": [compressor.compress(r) for r in records]}
        if waiting:
            yield {"frame": start()[1]}

    folder = shared_path(pages.sparkSession, "warc")
    write_raw(map_batches(planned, work, "frame binary"), "frame", folder, EMPTY_FRAME)
    return folder


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, record_type, payload_digest, payload_bytes, record_id, refers_id, url, error.

    A revisit holds no payload; its length and target come from the response it refers to.
    """

    def work(batches):
        names = ("page_id", "record_type", "payload_digest", "payload_bytes", "record_id", "refers_id", "url", "error")
        for batch in batches:
            for content in batch["content"]:
                rows = {n: [] for n in names}
                for data in frames(content.as_py()):
                    row = dict.fromkeys(names)
                    try:
                        if isinstance(data, ValueError):
                            raise data
                        found = parse_record(data)
                        h = found["headers"]
                        row["page_id"] = int(h["x-page-id"]) if "x-page-id" in h else None
                        row |= {"record_type": h["warc-type"], "record_id": h["warc-record-id"], "refers_id": h.get("warc-refers-to"), "url": h.get("warc-target-uri")}
                        row["payload_digest"] = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        row["payload_bytes"] = len(found["payload"]) if h["warc-type"] == "response" else None
                    except ValueError as error:
                        row["error"] = str(error)
                    for n in names:
                        rows[n].append(row[n])
                    if len(rows["page_id"]) >= 10_000:
                        yield rows
                        rows = {n: [] for n in names}
                yield rows

    schema = "page_id long, record_type string, payload_digest string, payload_bytes long, record_id string, refers_id string, url string, error string"
    return map_batches(read_raw(spark, folder), work, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Add refers_to and fill payload_bytes of revisits from the records they name.

    Only responses that are referred to and one row per record id take part in the join; the
    hot ids are spread by a salt.
    """
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")
    revisits = records.filter("record_type = 'revisit'")
    named = revisits.select(F.col("refers_id").alias("_id")).distinct()
    target = (
        records.filter("record_type = 'response'")
        .groupBy(F.col("record_id").alias("_id"))
        .agg(F.min("page_id").alias("_page"), F.min("payload_bytes").alias("_bytes"))
        .join(named, "_id", "left_semi")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    joined = (
        revisits.withColumn("_salt", salt)
        .withColumn("_id", F.col("refers_id"))
        .join(target, ["_id", "_salt"], "left")
        .select(
            *[c for c in records.columns if c not in ("payload_bytes", "error")],
            F.col("_bytes").alias("payload_bytes"),
            F.when(F.col("_bytes").isNull(), F.lit("revisit of an unknown record")).otherwise(F.col("error")).alias("error"),
            F.col("_page").alias("refers_to"),
        )
    )
    rest = records.filter("record_type is null or record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return rest.unionByName(joined)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` and return what reading them back gives."""
    folder = write_archives(pages, min_revisit_bytes)
    return resolve_revisits(saved(read_archives(pages.sparkSession, folder), "warc-rows"))
