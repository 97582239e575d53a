"""Benchmark decontamination by templates.

A text becomes a sequence of canonical tokens: numbers, names (capitalised words inside a
sentence) and units (after a number) turn into typed placeholders, all other words are lowered.
Windows of ``width`` canonical tokens are hashed and joined between benchmark and documents, so a
question whose numbers or names were exchanged still meets its template. The values in the slots
of the joined windows then have to agree: one value of the item may stand for one value in the
document only, and the other way round. Every window is also joined by its lowered words as they
stand, so a verbatim copy is found whatever its tokens became. Windows that are placeholders for
more than half say nothing as a template and are joined by their words only.

A document is contaminated by an item when windows cover at least ``coverage`` of the item's
tokens and at least ``consistency`` of the slot values agree, in the whole document or in one
occurrence: the windows that lie equally far from their places in the item, or, with insertions,
in a stretch of the item's length. Other variants in the document don't hide an occurrence. Items
shorter than ``width`` are one window of their own length; with fewer than five tokens they are
found verbatim only.

Defined cases: null, empty and wordless texts match nothing; items with the same canonical tokens
and slot values count as the one with the smallest id; rows with equal texts get equal results, and a
null doc_id or item_id keeps its rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelinekit.llm.common import kept, map_batches, saved

# The name under which workers keep known pieces.
KEPT = "decontamination-pieces"

# fixed values: units that may follow a number
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs hours minutes seconds days weeks months years"
    " k c f km/h mph m/s hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal pa bar usd eur gbp dollars cents euros percent"
    " meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres degrees".split()
)
WIDTH = 8
COVERAGE = 0.5
CONSISTENCY = 0.8
MIN_TEMPLATE_TOKENS = 5
# keeps hashes of words apart from hashes of templates
VERBATIM = 0x5851F42D4C957F2D
# windows of the benchmark up to which their hashes are sent to every task (8 bytes each)
FILTER_WINDOWS = 4_000_000

PIECE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[+-]?[0-9]+(?:[.,][0-9]+)*|[%°$€£]|[.!?\n]")
NUMBER, NAME, UNIT = "\x00number", "\x00name", "\x00unit"
# classes of pieces: word, stop, number, currency sign, word that may be a unit, sign of a unit
PLAIN, STOP, DIGITS, MONEY, MEASURE, SIGN = range(6)


class Pieces:
    """What is known of pieces, each judged once: spelling, class, capital, number.

    ``chunks`` maps a stretch without blanks to the places of its pieces. Long stretches are read
    anew each time, and all is forgotten between texts once it has grown past ``bound``.
    """

    def __init__(self, bound: int = 800_000):
        import xxhash

        self.bound = bound
        self.digest = xxhash.xxh64_intdigest
        self.forget()

    def forget(self) -> None:
        self.chunks = Chunks(self)
        self.places: dict[str, int] = {}
        self.spelled: list[str] = []
        self.classes = np.zeros(4_096, dtype=np.uint8)
        self.capitals = np.zeros(4_096, dtype=bool)
        self.numbers = np.zeros(4_096, dtype=np.uint64)

    def place(self, piece: str) -> int:
        at = self.places.get(piece)
        if at is not None:
            return at
        at = self.places[piece] = len(self.spelled)
        self.spelled.append(piece)
        if at == len(self.classes):
            self.classes, self.capitals, self.numbers = (np.concatenate([a, np.zeros_like(a)]) for a in (self.classes, self.capitals, self.numbers))
        first, low = piece[0], piece.lower()
        self.numbers[at] = self.digest(low)
        if low == piece and first.isalpha():
            if low in UNITS:
                self.classes[at] = MEASURE
            return at
        if first != low[0]:
            self.capitals[at] = True
        if first in ".!?\n":
            self.classes[at] = STOP
        elif first.isdigit() or first in "+-":
            self.classes[at] = DIGITS
        elif first in "$€£":
            self.classes[at] = MONEY
        elif first in "%°":
            self.classes[at] = SIGN
        elif low in UNITS:
            self.classes[at] = MEASURE
        return at

    def read(self, text: str) -> np.ndarray:
        """Places of the pieces of a text, in order; no piece holds a blank."""
        if len(self.chunks) > self.bound or len(self.spelled) > self.bound:
            self.forget()
        chunks = text.replace("\n", " \n ").split(" ")
        return np.fromiter(chain.from_iterable(map(self.chunks.__getitem__, chunks)), dtype=np.int64)


def known_pieces() -> Pieces:
    """One per worker process, so that tasks go on with what earlier ones have seen."""
    return kept(KEPT, Pieces)


class Chunks(dict):
    def __init__(self, pieces: Pieces, longest: int = 64):
        super().__init__()
        self.pieces, self.longest = pieces, longest

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = tuple(map(self.pieces.place, PIECE.findall(chunk)))
        if len(chunk) <= self.longest:
            self[chunk] = found
        return found


@dataclass
class Canonical:
    """A text's tokens as numbers, whether each is literal, the values of the others, and the numbers of all words."""

    numbers: np.ndarray
    words: np.ndarray
    literal: np.ndarray
    classes: np.ndarray
    places: np.ndarray
    spelled: list[str]

    def value(self, i: int) -> str:
        piece = self.spelled[self.places[i]]
        return piece.lower() if self.classes[i] == MEASURE else piece

    def slots(self, at: int, width: int) -> str:
        """The slot values of a window as one string: place, unit separator, value."""
        return "\x1e".join(f"{i}\x1f{self.value(at + i)}" for i in np.flatnonzero(~self.literal[at : at + width]).tolist())


def canonical(text: str | None, known: Pieces) -> Canonical:
    """What a piece becomes depends on itself and on the piece before it.

    A unit needs a number right before it; a sign without one is passed over. A capitalised word
    is a name unless it opens a sentence.
    """
    places = known.read(text or "")
    classes = known.classes[places]
    after_number = np.append(False, classes == DIGITS)[:-1]
    there = (classes != SIGN) | after_number
    places, classes, after_number = places[there], classes[there], after_number[there]
    opening = np.append(True, classes == STOP)[:-1]
    unit = (classes == MONEY) | (classes == SIGN) | ((classes == MEASURE) & after_number)
    name = known.capitals[places] & ~opening & ~unit
    number = classes == DIGITS
    numbers = known.numbers[places]
    for chosen, token in ((number, NUMBER), (unit, UNIT), (name, NAME)):
        numbers[chosen] = known.digest(token)
    # a name that could be a unit elsewhere keeps its spelling
    classes[name] = PLAIN
    real = classes != STOP
    return Canonical(numbers[real], known.numbers[places[real]], ~(number | unit | name)[real], classes[real], places[real], known.spelled)


def window_hashes(numbers: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of the windows at every place."""
    n = len(numbers) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(width ^ seed), dtype=np.uint64)
    for i in range(width):
        total = (total ^ numbers[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def windows(text: Canonical, width: int) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """(is a template, places, signed hashes): windows by their words, and those literal for at least half as templates."""
    hashes = window_hashes(text.words, width, VERBATIM).view(np.int64)
    found = [(False, np.arange(len(hashes)), hashes)]
    if width >= MIN_TEMPLATE_TOKENS and len(hashes):
        sums = np.concatenate([[0], np.cumsum(text.literal)])
        telling = np.flatnonzero((sums[width:] - sums[:-width]) * 2 >= width)
        found.append((True, telling, window_hashes(text.numbers, width).view(np.int64)[telling]))
    return found


def _items(batches, width: int):
    known = known_pieces()
    for batch in batches:
        out = {c: [] for c in ("item_id", "form", "tokens", "width", "place", "hash", "item_slots")}
        for item_id, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
            item = canonical(text, known)
            size = len(item.numbers)
            if not size:
                continue
            own = min(width, size)
            form = item.numbers.tobytes().hex() + item.slots(0, size)
            for template, places, hashes in windows(item, own):
                for p, h in zip(places.tolist(), hashes.tolist()):
                    for c, x in zip(out, (item_id, form, size, own, p, h, item.slots(p, own) if template else "")):
                        out[c].append(x)
        yield out


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, tokens, width, place, hash, item_slots) of every window of distinct items; no slots where it goes by its words."""
    schema = "item_id long, form string, tokens int, width int, place int, hash long, item_slots string"
    rows = map_batches(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), partial(_items, width=width), schema, KEPT)
    rows = rows.withColumn("form", F.sha2("form", 256))
    return rows.groupBy("form", "tokens", "width", "place", "hash", "item_slots").agg(F.min("item_id").alias("item_id")).drop("form")


def _documents(batches, widths: list[int], wanted):
    known, keep = known_pieces(), None if wanted is None else wanted.value
    for batch in batches:
        out = {c: [] for c in ("doc_id", "doc_key", "width", "hash", "doc_place", "doc_slots")}
        for doc_id, key, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "doc_key", "text"))):
            doc = canonical(text, known)
            for width in widths:
                for template, places, hashes in windows(doc, width):
                    if keep is not None and len(keep):
                        at = np.minimum(np.searchsorted(keep, hashes), len(keep) - 1)
                        hit = keep[at] == hashes
                        places, hashes = places[hit], hashes[hit]
                    elif keep is not None:
                        places = places[:0]
                    for p, h in zip(places.tolist(), hashes.tolist()):
                        for c, x in zip(out, (doc_id, key, width, h, p, doc.slots(p, width) if template else "")):
                            out[c].append(x)
        yield out


def occurrences(shift: Column, tokens: Column) -> Column:
    """What a window is judged in, as (kind, at): the whole document, one alignment, and stretches of
    the item's length, dealt twice so that one close to a border lies inside another."""
    part = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    near = [F.floor((shift + half) / tokens) for half in (F.lit(0), tokens / 2)]
    return F.array(part(0, F.lit(0)), part(1, shift), part(2, near[0]), part(3, near[1]))


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """(doc_id, doc_key, item_id, covered, coverage, slots, consistency): a row for each contaminated pair.

    doc_key is ``xxhash64(text)``, by which rows can be removed whatever their ids. Benchmark
    hashes are counted first: up to ``FILTER_WINDOWS`` they go to the tasks as a sorted array and
    only windows that occur in the benchmark leave a task; beyond, all windows are shuffled.
    """
    spark = docs.sparkSession
    asked = saved(benchmark_windows(items, width), "benchmark-windows")
    widths = sorted(r["width"] for r in asked.select("width").distinct().collect())
    few = asked.select("hash").distinct()
    wanted = None
    if few.count() <= FILTER_WINDOWS:
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r["hash"] for r in few.toLocalIterator()], dtype=np.int64)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), "text")
    found = map_batches(rows, partial(_documents, widths=widths, wanted=wanted), "doc_id long, doc_key long, width int, hash long, doc_place int, doc_slots string", KEPT)
    joined = saved(found.join(asked, ["width", "hash"]), "template-matches")

    # a window covers the tokens from its place on; places are at most as many as the item has tokens
    pair, judged = ["doc_id", "doc_key", "item_id"], ["doc_id", "doc_key", "item_id", "within"]
    placed = joined.withColumn("within", F.explode(occurrences(F.col("doc_place") - F.col("place"), F.col("tokens"))))
    places = placed.groupBy(*judged, "tokens", "width").agg(F.collect_set("place").alias("places"))
    inside = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1)))
    covered = places.select(*judged, "tokens", F.size(F.array_distinct(inside)).cast("long").alias("covered")).filter(F.col("covered") / F.col("tokens") >= coverage)
    part = lambda c, i: F.split_part(c, F.lit("\x1f"), F.lit(i))
    both = placed.filter("item_slots <> ''").select(
        *judged, F.explode(F.arrays_zip(F.split("item_slots", "\x1e").alias("i"), F.split("doc_slots", "\x1e").alias("d"))).alias("s")
    )
    values = both.select(*judged, part(F.col("s.i"), 2).alias("own"), part(F.col("s.d"), 2).alias("seen")).distinct()
    agreed = values.groupBy(*judged).agg(
        F.count(F.lit(1)).alias("slots"), F.count_distinct("own").alias("owns"), F.count_distinct("seen").alias("seens")
    )
    same = [covered[c].eqNullSafe(agreed[c]) for c in judged]
    ratio = F.coalesce(F.least("owns", "seens") / F.col("slots"), F.lit(1.0))
    scored = covered.join(agreed, same, "left").select(
        *[covered[c] for c in judged],
        "covered",
        (F.col("covered") / F.col("tokens")).alias("coverage"),
        F.coalesce("slots", F.lit(0)).alias("slots"),
        ratio.alias("consistency"),
    )
    # one row per pair: of the whole document if that is enough, else of the best covered occurrence
    figures = ["covered", "coverage", "slots", "consistency"]
    order = F.struct("within.kind", -F.col("covered"), -F.col("consistency"), "within.at")
    best = scored.filter(F.col("consistency") >= consistency).groupBy(*pair).agg(F.min_by(F.struct(*figures), order).alias("best"))
    return best.select(*pair, *[F.col(f"best.{c}").alias(c) for c in figures])
