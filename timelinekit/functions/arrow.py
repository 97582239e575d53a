"""Arrow-batched UDFs for the few rules that have no built-in expression."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


@F.pandas_udf(T.StringType())
def html_unescape_ended(text: pd.Series) -> pd.Series:
    """Decodes entities that end in a semicolon; ``&amp`` alone stays."""

    def ended(match: re.Match) -> str:
        name = match.group(1)
        return html.unescape(match.group()) if name is None or f"{name};" in html.entities.html5 else match.group()

    return text.map(lambda s: _ENTITY.sub(ended, s), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s).casefold(), na_action="ignore")


def sequence_ratio(threshold: float = 0.0):
    """UDF: difflib ratio of two token arrays; the argument order is part of the rule.

    The multiset overlap bounds the ratio from above. Where the bound is already below
    ``threshold`` it is returned instead, so results at or above the threshold are exact.
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a, b) -> float:
            if len(a) == 0 or len(b) == 0:
                return 0.0
            shared = sum((Counter(a) & Counter(b)).values())
            bound = 2.0 * shared / (len(a) + len(b))
            if bound < threshold:
                return bound
            return SequenceMatcher(None, list(a), list(b), autojunk=False).ratio()

        return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="float64")

    return ratio


_PREFIX = T.StructType([
    T.StructField("size", T.IntegerType()),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("at", T.IntegerType())]))),
])


def rare_prefix(counts: np.ndarray, needed: float, multiset: bool, epsilon: float):
    """UDF: the number of hashed tokens of a text and its rarest ones (``item``, and in ``at`` how many come before).

    Tokens are ordered by ``counts`` of their low bits, then by hash. Texts that share ``needed`` of their
    tokens must share one of these. ``multiset`` counts repeats of a token, otherwise it counts once.
    """

    @F.arrow_udf(_PREFIX)
    def prefix(hashes: pa.Array) -> pa.Array:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(hashes)), lengths)
        order = np.lexsort((flat, counts[flat & (len(counts) - 1)], row))
        flat, row = flat[order], row[order]
        first = np.ones(len(flat), dtype=bool)
        first[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        begins = np.flatnonzero(first)
        weight = np.diff(np.append(begins, len(flat))) if multiset else np.ones(len(begins), dtype=np.int64)
        flat, row = flat[begins], row[begins]
        size = np.bincount(row, weight, len(hashes)).astype(np.int64)
        at = np.cumsum(weight) - weight - (np.cumsum(size) - size)[row]
        keep = np.maximum(size - np.ceil(size * needed - epsilon).astype(np.int64) + 1, 1)
        inside = at < keep[row]
        offsets = np.append(0, np.cumsum(np.bincount(row[inside], minlength=len(hashes))))
        entries = pa.StructArray.from_arrays([pa.array(flat[inside]), pa.array(at[inside].astype(np.int32))], ["item", "at"])
        items = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries)
        return pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), items], ["size", "items"])

    return prefix


def _bit_rows(tokens) -> tuple[dict, int]:
    """Per token a bit set of its places, and the mask of all places."""
    places: dict = {}
    for at, token in enumerate(tokens):
        places[token] = places.get(token, 0) | (1 << at)
    return places, (1 << len(tokens)) - 1


def _lcs(a, b) -> int:
    if len(a) == 0 or len(b) == 0:
        return 0
    places, mask = _bit_rows(b)
    row = mask
    for token in a:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(b) - bin(row).count("1")


def _distance(a, b) -> int:
    if len(a) == 0 or len(b) == 0:
        return max(len(a), len(b))
    places, mask = _bit_rows(b)
    top = 1 << (len(b) - 1)
    up, down, distance = mask, 0, len(b)
    for token in a:
        equal = places.get(token, 0)
        diagonal = ((((equal & up) + up) ^ up) | equal) | down
        rise, fall = down | (~(diagonal | up) & mask), up & diagonal
        distance += 1 if rise & top else (-1 if fall & top else 0)
        rise, fall = ((rise << 1) | 1) & mask, (fall << 1) & mask
        up, down = fall | (~(diagonal | rise) & mask), rise & diagonal
    return distance


_COMPARED = T.StructType([T.StructField("edit_distance", T.IntegerType()), T.StructField("lcs", T.IntegerType())])


@F.pandas_udf(_COMPARED)
def token_comparison(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Token edit distance and longest common subsequence of two arrays of any vocabulary.

    Both run over bit rows of whole numbers: a token of the left side costs a few operations on
    integers as long as the right side, not a loop over it.
    """
    found = [(_distance(a, b), _lcs(a, b)) for a, b in zip(left, right)]
    return pd.DataFrame(found, columns=["edit_distance", "lcs"], dtype="int32")


def transcript_comparison(max_lead_s: float):
    """UDF on one transcript's arrays: ``token_comparison``, the start differences of equal words, and
    the number of clips whose first word comes more than ``max_lead_s`` after the clip's start.

    Arguments: words and their starts of either side, starts and ends of the clips of the left one.
    """

    def late(starts, clips_from, clips_to) -> int:
        ordered, n = sorted(float(s) for s in starts), 0
        for a, b in zip(clips_from, clips_to):
            first = bisect_left(ordered, a - 1e-6)
            n += first < len(ordered) and ordered[first] < b - 1e-6 and ordered[first] - a > max_lead_s
        return n

    @F.pandas_udf(T.StructType([*_COMPARED.fields, T.StructField("drifts", T.ArrayType(T.DoubleType())), T.StructField("lead_ins", T.IntegerType())]))
    def compare(
        left: pd.Series, left_at: pd.Series, right: pd.Series, right_at: pd.Series, clip_from: pd.Series, clip_to: pd.Series
    ) -> pd.DataFrame:
        rows = list(zip(left, left_at, right, right_at, clip_from, clip_to))
        return pd.DataFrame({
            "edit_distance": [_distance(r[0], r[2]) for r in rows], "lcs": [_lcs(r[0], r[2]) for r in rows],
            "drifts": [_drifts(*r[:4]) for r in rows], "lead_ins": [late(r[1], r[4], r[5]) for r in rows],
        })

    return compare


def _drifts(words, times, heard, heard_at) -> list[float]:
    """Start differences of words matched greedily forward by equal token."""
    where: dict = {}
    for at, token in enumerate(heard):
        where.setdefault(token, []).append(at)
    found, pointer = [], 0
    for token, time in zip(words, times):
        places = where.get(token, ())
        nth = bisect_left(places, pointer)
        if nth < len(places):
            pointer = places[nth] + 1
            found.append(abs(float(heard_at[places[nth]]) - float(time)))
    return found


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def matched_drifts(
    expected: pd.Series, expected_at: pd.Series, actual: pd.Series, actual_at: pd.Series
) -> pd.Series:
    return pd.Series([_drifts(*row) for row in zip(expected, expected_at, actual, actual_at)])
