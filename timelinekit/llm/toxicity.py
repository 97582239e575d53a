"""Toxicity by weak supervision.

1. On a bounded sample of labelled rows (``sample_rows``, the smallest hashes of doc_id), words
   are counted by label; those that stand out become lexicon voters, beside a public list of
   insults and a few patterns. Each voter says toxic, clean or nothing.
2. A generative label model estimates every voter's accuracy by expectation maximisation and the
   correlation of voters given the class; correlated voters share their weight, so that ten
   copies of one hint do not count as ten. The given label takes part as one more voter, whose
   accuracy is estimated like any other's.
3. A linear classifier is trained on the posterior labels with word and pattern features only.

Scoring maps every whole text to the classifier's features; labels, language, source and id are
never inputs. Defined cases: null and blank texts are scored by the intercept; without labelled
rows only the public list and the patterns decide; a null or repeated doc_id keeps its row; a
label of a repeated or null id is not learned from when it is null, and of rows with the same id
the greatest text is learned from; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelinekit.llm.common import hold_out, map_batches, saved

# fixed values: common English insults
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown", "clowns", "dumb", "imbecile", "retard", "bastard", "bitch", "asshole", "fuck", "fucking", "shit", "cunt", "whore", "slut", "faggot", "vermin", "filth")
# fixed values: what patterns look for
PATTERNS = (
    ("masked", r"\b[a-z]+\*+[a-z]+\b"),
    ("addressed", r"\byou(?:'re| are)? (?:an? |all |such an? )?(?:" + "|".join(INSULTS) + r")\b"),
    ("shouting", r"!{3,}"),
    ("wish", r"\b(?:kill|hate|hurt) (?:yourself|you|them all)\b"),
)

WORD = re.compile(r"\w+")
SAMPLE_ROWS = 20_000
MIN_DOCS = 5
MIN_Z = 6.0
LEXICON = 48
VOCABULARY = 2_048


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        found = features(text, self.words)
        return float(1 / (1 + np.exp(-(self.intercept + self.weights[found].sum()))))


def features(text: str | None, words: dict[str, int]) -> list[int]:
    """Indexes of the vocabulary words and patterns that the text holds, each once."""
    low = (text or "").lower()
    found = [words[w] for w in words.keys() & set(WORD.findall(low))]
    return found + [len(words) + i for i, (_, p) in enumerate(PATTERNS) if re.search(p, low)]


def _shared_weight(residuals: np.ndarray) -> np.ndarray:
    """One over the sum of a voter's positive correlations, its own included."""
    left = residuals - residuals.mean(axis=0)
    spread = left.std(axis=0) + 1e-9
    return 1 / np.clip(left.T @ left / max(1, len(left)) / np.outer(spread, spread), 0, 1).sum(axis=0).clip(1)


def label_model(votes: np.ndarray, start: np.ndarray | None = None, hints: int | None = None, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, accuracy by voter, weight by voter) of votes in {1, -1, 0}.

    Two classes; a voter has its own chance of each vote in each class, estimated by expectation
    maximisation from ``start`` (else the weighted majority), whose class balance is kept. A vote
    may only speak for its own class, which keeps the classes from changing places; a missing vote
    says nothing. Weights come from the correlations that the class means leave unexplained, taken
    among the first ``hints`` voters (all, if not given); the others keep weight one.
    """
    hints = votes.shape[1] if hints is None else hints
    rest = np.ones(votes.shape[1] - hints)
    weight = np.concatenate([_shared_weight(votes[:, :hints]), rest])
    if start is None:
        lean = votes @ weight
        start = 1 / (1 + np.exp(-4 * lean / max(1e-9, np.abs(lean).max())))
    post = np.clip(start, 0.02, 0.98)
    prior = float(np.clip(post.mean(), 0.01, 0.99))
    kinds = {v: (votes == v).astype(np.float64) for v in (1, -1)}
    for turn in range(rounds):
        if turn in (0, rounds // 2):
            means = [np.average(votes, axis=0, weights=p + 1e-9) for p in (1 - post, post)]
            left = votes - np.outer(1 - post, means[0]) - np.outer(post, means[1])
            weight = np.concatenate([_shared_weight(left[:, :hints]), rest])
        chance = {v: np.array([(p @ k + 0.1) / (p.sum() + 0.3) for p in (1 - post, post)]) for v, k in kinds.items()}
        speak = {v: v * np.maximum(0, v * np.log(c[1] / c[0])) for v, c in chance.items()}
        lean = sum(k @ (weight * speak[v]) for v, k in kinds.items())
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + lean, -30, 30)))
    good = chance[1][1] * prior + chance[-1][0] * (1 - prior)
    return post, good / (good + chance[-1][1] * prior + chance[1][0] * (1 - prior)), weight


def linear_fit(at: np.ndarray, cols: np.ndarray, target: np.ndarray, size: int, penalty: float = 1e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute penalty on sparse 0/1 rows given as (row, column) pairs.

    Steps adapt to each feature, so that rare words are learned as fast as frequent ones.
    """
    w, b, n = np.zeros(size), 0.0, max(1, len(target))
    seen, seen_b = np.full(size, 1e-12), 1e-12
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[cols], n)[:n] + b, -30, 30))) - target
        slope, slope_b = np.bincount(cols, gap[at], size) / n, gap.sum() / n
        seen += slope**2
        seen_b += slope_b**2
        rate = 0.5 / np.sqrt(seen)
        w = w - rate * slope
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b -= 0.5 / np.sqrt(seen_b) * slope_b
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled rows outside the held-out fifth.

    Words are counted by Spark; the driver receives the standing-out words and, for each sampled
    row, the indexes of those it holds, never a text.
    """
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & ~hold_out(0, 5)).join(docs.select("doc_id"), "doc_id", "left_semi")
    # ids are drawn first, so that no task gathers texts; at most sample_rows of them are sent to every task
    chosen = known.withColumn("_draw", F.xxhash64("doc_id")).orderBy("_draw", "doc_id").limit(sample_rows).select("doc_id", "toxic")
    chosen = saved(chosen, "toxicity-ids")
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def spread(batches):
        for batch in batches:
            held = [(w, t) for x, t in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()) for w in set(WORD.findall((x or "").lower()))]
            yield {"word": [w for w, _ in held], "toxic": [t for _, t in held]}

    drawn = saved(drawn.select("text", "toxic"), "toxicity-sample")
    drawn = drawn.repartition(max(8, drawn.sparkSession.sparkContext.defaultParallelism))
    sizes = {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sum(n for t, n in sizes.items() if t != 1)
    per_word = map_batches(drawn, spread, "word string, toxic int").groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") != 1).alias("good")
    )
    share = bad / max(1, bad + good)
    n = F.col("bad") + F.col("good")
    z = (F.col("bad") - n * share) / F.sqrt(n * F.lit(share * (1 - share)))
    ranked = per_word.filter(n >= MIN_DOCS).withColumn("z", z).filter(F.abs("z") >= MIN_Z) if bad and good else None
    top = ranked.orderBy(F.abs("z").desc(), "word").limit(VOCABULARY).collect() if ranked is not None else []
    leading = [r["word"] for r in sorted(top, key=lambda r: (-r["z"], r["word"])) if r["z"] > 0][:LEXICON]
    words = {w: i for i, w in enumerate(dict.fromkeys([*INSULTS, *leading, *(r["word"] for r in top)]))}
    voters = [*dict.fromkeys([*INSULTS, *leading])]

    def index(batches):
        for batch in batches:
            yield {"found": [features(t, words) for t in batch["text"].to_pylist()], "toxic": batch["toxic"]}

    indexed = map_batches(drawn, index, "found array<int>, toxic int").toArrow().combine_chunks() if words else None
    found = indexed.column("found").combine_chunks() if indexed is not None and len(indexed) else None
    sizes_of = np.diff(found.offsets.to_numpy()) if found is not None else np.zeros(0, np.int64)
    own = found.flatten().to_numpy() if found is not None else np.zeros(0, np.int64)
    toxic = indexed.column("toxic").to_numpy() if found is not None else np.zeros(0)
    # beside the sample stand a row for each public insult and as many without any word, so that the list decides without labels
    n = len(sizes_of) + 2 * len(INSULTS)
    at = np.concatenate([np.repeat(np.arange(len(sizes_of)), sizes_of), np.arange(len(sizes_of), len(sizes_of) + len(INSULTS))])
    cols = np.concatenate([own, [words[w] for w in INSULTS]]).astype(np.int64)
    marks = np.array([words[w] for w in voters] + [len(words) + i for i in range(len(PATTERNS))])
    place = np.full(len(words) + len(PATTERNS), -1)
    place[marks] = np.arange(len(marks))
    votes = np.zeros((n, len(marks) + 2))
    telling = place[cols] >= 0
    votes[at[telling], place[cols[telling]]] = 1
    votes[:, -2] = np.where((votes[:, : len(voters)] > 0).any(axis=1), 1, -1)
    votes[: len(toxic), -1] = np.where(toxic == 1, 1, -1)
    # the model starts from the given labels and, beside the sample, from the list
    anchor = np.where(votes[:, -1] == 0, votes[:, -2], votes[:, -1])
    post, _, _ = label_model(votes, np.where(anchor > 0, 0.98, 0.02), hints=len(marks))
    weights, intercept = linear_fit(at, cols, post, len(words) + len(PATTERNS))
    return Model(words, weights, intercept)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the score of every row of ``docs``."""
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def work(batches):
        for batch in batches:
            yield {c: batch[c] for c in keep} | {"score": [model.score(t) for t in batch["text"].to_pylist()]}

    return map_batches(rows, work, f"{fields}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit(docs, labels, sample_rows)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return scored.select("doc_id", hold_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
