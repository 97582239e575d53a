"""DuckDB SQL of the operators that SQL can state."""

from __future__ import annotations

import string

# CRC-32 from its rule: a table of 256 remainders, then one step per byte.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc(text: str) -> str:
    """CRC-32 of a VARCHAR expression; ``crc_table`` must be in scope."""
    octets = f"list_transform(range(length(hex({text})) // 2), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


def resampling(percent: int = 10, buckets: int = 10_000, min_words: int = 20, seed: int = 2024) -> str:
    found = (
        f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),"
        r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH {_CRC_TABLE},
docs AS (SELECT row_number() OVER () AS row, doc_id, {found} AS w FROM documents),
raw AS (SELECT row, unnest(w) AS word FROM docs),
wanted AS (SELECT unnest({found}) AS word FROM benchmark),
coded AS (
  SELECT word, {_crc('word')} % {buckets} AS bucket
  FROM (SELECT word FROM raw UNION SELECT word FROM wanted), crc_table),
s AS (SELECT bucket, count(*) AS n FROM raw JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN coded USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {buckets})
    / ((s.n + 1)::DOUBLE * (t_all + {buckets}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM raw JOIN coded USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (row)),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, r.rank
FROM scored LEFT JOIN (SELECT row, rank FROM ranked WHERE rank <= n * {percent} // 100) r USING (row)
"""


def quality(buckets: int, pair_factor: int, lost: int) -> str:
    return rf"""
WITH {_CRC_TABLE},
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
coded AS (
  SELECT word, {_crc('word')} AS crc
  FROM (SELECT word FROM words UNION SELECT doc_id::VARCHAR FROM docs WHERE doc_id IS NOT NULL), crc_table),
placed AS (
  SELECT row, pos, crc % {buckets} AS bucket, lead(crc % {buckets}) OVER near AS following,
    CASE WHEN lead(word, 4) OVER near IS NOT NULL
      THEN word || ' ' || lead(word, 1) OVER near || ' ' || lead(word, 2) OVER near || ' ' || lead(word, 3) OVER near || ' ' || lead(word, 4) OVER near
    END AS five
  FROM words JOIN coded USING (word)
  WINDOW near AS (PARTITION BY row ORDER BY pos)),
twice AS (SELECT row, pos, five IS NOT NULL AND count(*) OVER (PARTITION BY row, five) > 1 AS again FROM placed),
covered AS (
  SELECT row, max(again::INT) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM twice),
repeats AS (SELECT row, sum(inside)::BIGINT AS n_repeat_words FROM covered GROUP BY row),
surface AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeats USING (row)),
grams AS (
  SELECT row, bucket FROM placed
  UNION ALL SELECT row, (bucket * {pair_factor} + following) % {buckets} FROM placed WHERE following IS NOT NULL),
trusted AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
halves AS (SELECT row, crc % 2 = 0 AS counted FROM docs JOIN trusted USING (doc_id) JOIN coded ON coded.word = docs.doc_id::VARCHAR),
s AS (SELECT bucket, count(*) AS n FROM grams GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM grams JOIN halves USING (row) WHERE counted GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {buckets})
    / ((s.n + 1)::DOUBLE * (t_all + {buckets}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
scores AS (SELECT row, floor(sum(gain)::BIGINT / count(*))::BIGINT AS score FROM grams JOIN gains USING (bucket) GROUP BY row),
judges AS (
  SELECT score, count(*) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY score) AS below,
    count(*) OVER () AS n
  FROM scores JOIN halves USING (row) WHERE NOT counted),
threshold AS (SELECT max(score) AS least FROM judges WHERE below * 1000 <= n * {lost} AND EXISTS (SELECT 1 FROM halves WHERE counted))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, score,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (least IS NULL OR coalesce(score >= least, false)) AS kept
FROM surface LEFT JOIN scores USING (row), threshold
"""


NEGATIVES = """
WITH usable AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
nodes AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM usable),
anchors AS (SELECT row_number() OVER () AS key, * FROM nodes WHERE vec_id % 100 = 0),
pairs AS (
  SELECT key, a.vec_id AS anchor_id, n.vec_id AS other_id, a.label = n.label AS same, list_dot_product(a.q, n.q)::BIGINT AS score
  FROM anchors a JOIN nodes n ON len(a.q) = len(n.q) AND a.vec_id <> n.vec_id),
positives AS (
  SELECT key, anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER near)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs USING (key)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW near AS (PARTITION BY key, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER near <= 5
"""
