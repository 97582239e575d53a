"""Personal data in texts, with built-in functions only.

Per kind a regular expression proposes spans, a validator confirms them (octets of an address,
Luhn, number of digits, mod-97) and words nearby move the score of the rest. ``email``, ``ip``,
``card`` and ``phone`` follow fixed rules and stay whatever the score; the method adds ``iban``
(mod-97), ``ssn`` and ``local_phone`` (number shapes that count only beside a telling word).

Positions come from the text itself: splitting at the matches gives the gaps, so lengths of gaps
and matches add up to the places, in code points. Patterns start at the left end of a run of
their first characters or where the last match ended, which changes no match and keeps the time
linear in the length of a run; repetitions are possessive, which keeps the stack flat. Matches are
folded in short lists whose results are joined, and what stands around a match is read from pieces
of ``PIECE`` characters, so time grows with the matches of a text and not with their square.

Context: words that tell of a kind raise the score of a span within ``CONTEXT`` characters, words
that tell of other numbers or of made-up data lower it. Added spans below ``THRESHOLD`` are dropped.

Defined cases: a null text counts as empty; texts without spans give zeros, empty strings and the
hash of the empty string; equal rows stay equal rows; a null doc_id keeps its row; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the kinds in their order
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")

CONTEXT = 40
THRESHOLD = 0.5
# more than the characters and blanks of any account number
LONGEST = 80
# texts are read in pieces of this length around a match; more than LONGEST and CONTEXT
PIECE = 256
# matches of a text that are folded together
LIST = 256
LOWER_BY = 0.3


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    near: str
    raise_by: float = 0.1
    # where ``pattern`` is the start of a span only: the whole span from there, tried at every start
    whole: str = ""


def _from_run(first: str) -> str:
    return rf"(?:(?<!{first})|\G)"


# fixed values: characters of a whole account number, by country
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
IBAN_START = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"


def _iban() -> str:
    """A number as long as its country's; of codes without a known length, as long as it goes."""
    rest = lambda n: rf"[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}"
    of = lambda length: "|".join(c for c, n in IBAN_LENGTHS.items() if n == length)
    known = "|".join(f"(?:{of(n)}){rest(n - 4)}" for n in sorted(set(IBAN_LENGTHS.values())))
    return f"^(?:{known}|(?!{'|'.join(IBAN_LENGTHS)})[A-Z]{{2}}{rest('11,30')})(?![A-Za-z0-9])"


# fixed values: shapes, first scores and telling words of each kind, in English, German, French and Spanish
CALL_WORDS = r"(?iu)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|handy|anruf|téléphone|appelez|teléfono|llame|móvil)\b"
OTHER_WORDS = r"(?iu)\b(?:example|sample|dummy|isbn|issn|serial|version|part number|tracking|beispiel|muster|exemple|ejemplo)\b"
KINDS = (
    Kind("email", _from_run("[A-Za-z0-9._%+-]") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
         r"(?iu)\b(?:e-?mail|mail|contact|write to|kontakt|courriel|correo)\b"),
    Kind("ip", _from_run("[0-9]") + r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", 0.8, r"(?iu)\b(?:ip|address|host|server|login|adresse|dirección)\b"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", 0.9, r"(?iu)\b(?:card|credit|debit|visa|mastercard|amex|karte|carte|tarjeta)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, CALL_WORDS),
    Kind("iban", IBAN_START, 0.9, r"(?iu)\b(?:iban|account|bank|konto|compte|cuenta)\b", whole=_iban()),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"(?i)\b(?:ssn|social security|tax id|id number)\b", 0.4),
    Kind("local_phone", r"(?<![0-9+)-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", 0.3, CALL_WORDS, 0.4),
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum over a string of digits is a multiple of ten."""
    places = F.reverse(F.split(digits, ""))

    def part(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, n: a + n) % 10 == 0


def _mod97(text: Column) -> Column:
    """The rearranged account number is one modulo 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))

    def feed(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (a * F.when(code >= 65, 100).otherwise(10) + value) % 97

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), feed) == 1)


def _octets(text: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(text, r"\."), small)


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return _octets(text)
    if kind == "card":
        digits = _digits(text)
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    if kind == "iban":
        return _mod97(text)
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)") & ~text.rlike("-00-|-0000$")
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where a lambda inside refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _gather(items: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Numbers gathered by a fold from the left: ``step(state, item)`` gives the next state (a number,
    0 at first), a number and whether it counts.

    A fold copies its state in every step, so lists of ``LIST`` items are folded on their own and
    their results joined: few copies of short arrays of numbers instead of one of all for each item.
    """
    state = lambda at, rows: F.struct(at.alias("at"), rows.alias("rows"))
    none = F.array().cast("array<int>")

    def one(acc: Column, item: Column) -> Column:
        after, row, counts = step(acc["at"], item)
        return state(after, F.when(counts, F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"]))

    def some(acc: Column, part: Column) -> Column:
        return _let(F.aggregate(part, state(acc["at"], none), one), lambda end: state(end["at"], F.concat(acc["rows"], end["rows"])))

    def all_(whole: Column) -> Column:
        last = F.greatest(F.floor((F.size(whole) - 1) / LIST), F.lit(0)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * LIST + 1, F.lit(LIST)))
        return F.aggregate(parts, state(F.lit(0), none), some)["rows"]

    return _let(items, all_)


def _part(pieces: Column, start: Column, length: Column) -> Column:
    """Up to ``PIECE`` characters of a text from a place (from 0), found in the two pieces that may hold them."""
    at = F.floor(start / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, at), F.lit("")), F.coalesce(F.get(pieces, at + 1), F.lit("")))
    return F.substring(two, start - at * PIECE + 1, length)


def _completed(kind: Kind, start: Column, pieces: Column) -> Column:
    """The span of ``kind.whole`` at a start, with an empty match where there is none."""
    match = F.regexp_extract(_part(pieces, start, F.lit(LONGEST)), kind.whole, 0)
    return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"))


def _apart(spans: Column) -> Column:
    """Spans in order without those that begin inside an earlier one."""

    def step(end: Column, span: Column) -> tuple[Column, Column, Column]:
        clear = end <= span["start"]
        return F.when(clear, span["end"]).otherwise(end), span["i"], clear

    def chosen(found: Column) -> Column:
        numbered = F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))
        return F.transform(_gather(numbered, step), lambda i: F.get(found, i))

    return _let(spans, chosen)


def _located(kind: Kind, text: Column) -> Column:
    """Array of (start, end, match) of every match of the kind's pattern."""

    def step(at: Column, pair: Column) -> tuple[Column, Column, Column]:
        start = at + pair["gap"]
        return start + pair["match"], start, F.lit(True)

    def placed(matches: Column) -> Column:
        lengths = F.zip_with(matches, F.split(text, kind.pattern, -1), lambda m, g: F.struct(F.length(m).alias("match"), F.length(g).alias("gap")))
        starts = _gather(F.filter(lengths, lambda p: p["match"].isNotNull()), step)
        return F.zip_with(matches, starts, lambda m, at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("match")))

    return _let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed)


def spans_of(kind: Kind, order: int, text: Column) -> Column:
    """Array of (start, kind_order, end, kind, score): the confirmed spans of one kind."""

    def scored(span: Column, pieces: Column) -> Column:
        before = _part(pieces, F.greatest(span["start"] - CONTEXT, F.lit(0)), F.least(span["start"], F.lit(CONTEXT)))
        around = F.concat_ws(" ", before, _part(pieces, span["end"], F.lit(CONTEXT)))

        def score(near: Column) -> Column:
            up = F.when(near.rlike(kind.near), kind.raise_by).otherwise(0.0)
            down = F.when(near.rlike(OTHER_WORDS), LOWER_BY).otherwise(0.0)
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.score) + up - down))

        return F.struct(
            span["start"].alias("start"), F.lit(order).alias("kind_order"), span["end"].alias("end"),
            F.lit(kind.name).alias("kind"), _let(around, score).alias("score"),
        )

    def confirmed(pieces: Column) -> Column:
        found = _located(kind, text)
        if kind.whole:
            found = F.transform(found, lambda s: _completed(kind, s["start"], pieces))
        right = F.filter(found, lambda s: valid(kind.name, s["match"]))
        out = F.transform(_apart(right) if kind.whole else right, lambda s: scored(s, pieces))
        return out if kind.name in BASE_KINDS else F.filter(out, lambda s: s["score"] >= THRESHOLD)

    out = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), confirmed)
    empty = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string,score:double>>")
    # most texts hold no match, and need none of the above
    return F.when(text.rlike(kind.pattern), out).otherwise(empty)


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one array of confirmed spans per kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[spans_of(k, i, text).alias(k.name) for i, k in enumerate(KINDS)])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, counts per kind, base_sha256, spans, top_score) of every row."""
    found = find_spans(docs)
    joined = lambda kinds: F.array_join(
        F.transform(F.array_sort(F.concat(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    every = [k.name for k in KINDS]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in every],
        F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.array_max(F.transform(F.concat(*every), lambda s: s["score"])).alias("top_score"),
    )
