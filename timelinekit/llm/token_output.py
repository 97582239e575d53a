"""Token-id files with directly addressable codes.

Every id is cut into 8-bit chunks. Level 0 holds the low chunk of all ids, level 1 the next
chunk of those ids that go on, and so forth. A bitmap per level marks the ids that go on, and a
rank directory (ones before every 512th bit) tells where in the next level an id continues. So
any id is found with one lookup per level and no block has to be decoded.

A file holds segments; a segment is a header, the table of its documents and the levels. Files
are numbered in document order. ``encode`` writes them, ``decode`` reads them back.

Defined cases: a null text counts as empty and still gets its end id; equal ids are ordered by
the hash of their text; null ids come first; an empty table gives no segment and no row; other
columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelinekit.llm.common import kept, map_batches, read_raw, saved, shared_path, write_raw

MAGIC = b"DACIDS01"
HEADER = struct.Struct("<8sIIIQBQ")  # magic, part, segment, documents, ids, levels, bytes that follow
RANK_BITS = 512
SEGMENT_IDS = 4_000_000
CACHED_WORDS = 800_000
JOINED_WORDS = 64
END = "\n"

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


@dataclass
class Codes:
    """One sequence of ids as chunk levels; ``goes_on`` has no entry for the last level."""

    levels: list[np.ndarray]
    goes_on: list[np.ndarray]
    ranks: list[np.ndarray]

    @staticmethod
    def pack(ids: np.ndarray) -> "Codes":
        levels, goes_on, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while True:
            levels.append((rest & 0xFF).astype(np.uint8))
            more = rest > 0xFF
            if not more.any():
                return Codes(levels, goes_on, ranks)
            bits = np.packbits(more, bitorder="little")
            goes_on.append(bits)
            ranks.append(_directory(bits))
            rest = rest[more] >> 8

    def rank(self, level: int, at: int) -> int:
        """Ids among the first ``at`` of the level that go on."""
        block = at // RANK_BITS
        first = block * (RANK_BITS // 8)
        whole = self.goes_on[level][first : at // 8]
        ones = int(self.ranks[level][block]) + int(_POPCOUNT[whole].sum())
        if at % 8:
            ones += int(_POPCOUNT[self.goes_on[level][at // 8] & ((1 << at % 8) - 1)])
        return ones

    def get(self, at: int) -> int:
        """The id at a position, by one lookup per level."""
        value = 0
        for level, chunks in enumerate(self.levels):
            value |= int(chunks[at]) << (8 * level)
            if level == len(self.goes_on) or not (self.goes_on[level][at // 8] >> (at % 8)) & 1:
                return value
            at = self.rank(level, at)
        return value

    def slice(self, first: int, last: int) -> np.ndarray:
        """Ids of [first, last); reads only the chunks of that range."""
        out = self.levels[0][first:last].astype("<u4")
        where = slice(None)
        for level, bits in enumerate(self.goes_on):
            if first == last:
                break
            here = np.unpackbits(bits[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first].view(bool)
            start = self.rank(level, first)
            first, last = start, start + int(here.sum())
            where = np.flatnonzero(here) if level == 0 else where[here]
            out[where] |= self.levels[level + 1][first:last].astype("<u4") << np.uint32(8 * (level + 1))
        return out


def _directory(bits: np.ndarray) -> np.ndarray:
    step = RANK_BITS // 8
    ones = np.add.reduceat(_POPCOUNT[bits].astype(np.int64), np.arange(0, len(bits), step))
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u8")


def segment(part: int, number: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    codes = Codes.pack(ids)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    body = [np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), known.tobytes(), np.array(lengths, dtype="<u8").tobytes()]
    body.append(np.array([len(x) for x in codes.levels], dtype="<u8").tobytes())
    for level, chunks in enumerate(codes.levels):
        body.append(chunks.tobytes())
        if level < len(codes.goes_on):
            body += [codes.goes_on[level].tobytes(), codes.ranks[level].tobytes()]
    rest = b"".join(body)
    rest += struct.pack("<I", zlib.crc32(rest))
    return HEADER.pack(MAGIC, part, number, len(doc_ids), len(ids), len(codes.levels), len(rest)) + rest


def segments(content: bytes):
    """(part, number, doc ids, lengths, codes) of every segment of a file; fails on damage."""
    at, view = 0, memoryview(content)
    while at < len(content):
        if len(content) - at < HEADER.size:
            raise ValueError(f"token file: cut off at byte {at}")
        magic, part, number, docs, n_ids, n_levels, size = HEADER.unpack_from(content, at)
        at += HEADER.size
        if magic != MAGIC or at + size > len(content):
            raise ValueError(f"token file: bad segment before byte {at}")
        body, at = view[at : at + size], at + size + len(END)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"token file: checksum of segment {number} of part {part}")
        pos = 0

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal pos
            found = np.frombuffer(body, dtype, count, pos)
            pos += found.nbytes
            return found

        ids, known, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
        sizes = take("<u8", n_levels)
        levels, goes_on, ranks = [], [], []
        for level, count in enumerate(map(int, sizes)):
            levels.append(take("u1", count))
            if level + 1 < n_levels:
                bytes_ = -(-count // 8)
                goes_on.append(take("u1", bytes_))
                ranks.append(take("<u8", -(-bytes_ // (RANK_BITS // 8)) + 1))
        if int(lengths.sum()) != n_ids or n_ids != len(levels[0]):
            raise ValueError(f"token file: lengths of segment {number} of part {part}")
        yield part, number, [int(d) if k else None for d, k in zip(ids, known)], [int(x) for x in lengths], Codes(levels, goes_on, ranks)


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    No pre-token of the vocabulary spans a blank, tab or line end, so a text's ids are those of
    its parts between them one after the other; parts seen before come from a bounded table that
    a worker keeps from task to task. A part of letters only is one pre-token, whose last id ends
    a word; such parts are encoded many at a time and taken apart at those ids. ASCII letters before
    a full stop or comma are a pre-token of their own; other letters may lower to a letter and a
    combining mark, which goes with the stop, so such parts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.reset()

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        return kept(f"tokens-{path}", lambda: cls(path))

    def reset(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self._add_each([",", "."])

    def _add_each(self, words: list[str]) -> None:
        for word, found in zip(words, self.model.encode_batch_fast(words, add_special_tokens=False)):
            self.known[word] = array("I", found.ids).tobytes()

    def _add_letters(self, words: list[str]) -> None:
        """Parts of letters only: ASCII ones go lowered to the vocabulary's model, which gets what the
        normaliser would give it; the rest is joined by blanks and cut after each id that ends a word."""
        plain = [w for w in words if w.isascii()]
        words = [w for w in words if not w.isascii()]
        known, merge = self.known, self.model.model.tokenize
        for w in plain:
            low = w.lower()
            found = known.get(low)
            if found is None:
                found = known[low] = array("I", [t.id for t in merge(low)]).tobytes()
            known[w] = found
        lists = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        for some, found in zip(lists, self.model.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                self._add_each(some)  # a letter that lowers to a letter and a mark makes two pre-tokens
                continue
            data, at = ids.tobytes(), 0
            for word, cut in zip(some, (cuts * 4).tolist()):
                self.known[word] = data[at:cut]
                at = cut

    def _learn(self, missing: set[str]) -> None:
        known, letters, others, marked = self.known, set(), [], []
        for w in missing:
            if w.isalpha():
                letters.add(w)
            elif w[-1] in ".," and w[:-1].isascii() and w[:-1].isalpha():
                marked.append(w)
                if w[:-1] not in known:
                    letters.add(w[:-1])
            else:
                others.append(w)
        self._add_letters(list(letters))
        self._add_each(others)
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.reset()
        get, out = self.known.get, []
        parts = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        first = [list(map(get, p)) for p in parts]
        self._learn({w for p, f in zip(parts, first) if None in f for w, b in zip(p, f) if b is None})
        for p, f in zip(parts, first):
            out.append(b"".join(map(self.known.__getitem__, p) if None in f else f))
        return out


def encode(docs: DataFrame, tokenizer: str, end_id: int, order: list[str] | None = None, segment_ids: int = SEGMENT_IDS) -> str:
    """Write the token files of ``docs`` in the order of ``order`` (doc_id) and return their folder.

    One range shuffle of the texts; a task encodes its range and writes its own file in segments
    of about ``segment_ids`` ids, which bounds its memory.
    """
    order = order or ["doc_id"]
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]
    by = [f"_by{i}" for i in range(len(order))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys)
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by, F.xxhash64("text")).select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def work(batches):
        from pyspark import TaskContext

        encoder, part, number = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, pieces, held = [], [], 0

        def flush():
            lengths = [len(p) // 4 for p in pieces]
            return {"segment": [segment(part, number, doc_ids, lengths, np.frombuffer(b"".join(pieces), "<u4"))]}

        for batch in batches:
            for doc_id, found in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                doc_ids.append(doc_id)
                pieces.append(found + end)
                held += len(found) // 4 + 1
                if held >= segment_ids:
                    yield flush()
                    doc_ids, pieces, held, number = [], [], 0, number + 1
        if doc_ids:
            yield flush()

    folder = shared_path(docs.sparkSession, "tokens")
    write_raw(map_batches(ranged, work, "segment binary", f"tokens-{tokenizer}"), "segment", folder, END)
    return folder


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, place) of every document in the files of ``folder``.

    ``start`` counts all ids before the document: the ids of earlier files (a running sum over
    one row per file) and of earlier documents of its file.
    """

    def work(batches):
        for batch in batches:
            for content in batch["content"]:
                for part, number, doc_ids, lengths, codes in segments(content.as_py()):
                    ends = np.cumsum(lengths).tolist()
                    yield {
                        "doc_id": doc_ids,
                        "n_tokens": lengths,
                        "ids_crc32": [zlib.crc32(codes.slice(e - n, e).tobytes()) for e, n in zip(ends, lengths)],
                        "part": [part] * len(doc_ids),
                        "segment": [number] * len(doc_ids),
                        "row": list(range(len(doc_ids))),
                    }

    schema = "doc_id long, n_tokens long, ids_crc32 long, part int, segment int, row int"
    rows = saved(map_batches(read_raw(spark, folder), work, schema), "token-rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment", "row")
    placed = rows.select(
        "*",
        F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inside"),
        F.row_number().over(inside).alias("place"),
    )
    return placed.join(files, "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "place")
