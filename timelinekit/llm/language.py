"""Language of every word and document by a linear-chain conditional random field.

States are the languages of the training rows. A word's features are its affixes (up to three
characters from either end), hashed n-grams of the whole word, its letters' scripts and lexicon
entries (words of up to 24 letters); transitions between neighbouring words are learned. Weights
come from maximising the conditional likelihood of a bounded sample of rows: gradients by
forward-backward over sequences of ``SEQUENCE`` words. Sequences of two languages joined in the
middle are among them, so that a change of language is seen as well as staying in one. In
code-switched text every word gets its own distribution.

A document's language is the one with the greatest mean posterior over its words, found by
forward-backward over the whole text: all texts of a batch form one chain whose links are cut
between documents; products of transfer matrices inside blocks run for all blocks at once. Only
a stretch of the chain, shorter the more languages there are, is unfolded at a time; stretches
hand on one vector in either direction.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled
row every text is ``und``; a null or repeated doc_id keeps its row and is predicted like any
other (for training, the greatest text of an id and language counts); a text of any length is
read whole, with a few bytes kept per word; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.llm.common import hold_out, kept, learned_from, map_batches, saved

UNKNOWN = "und"
SAMPLE_ROWS = 4_000
SEQUENCE = 24
SEQUENCES_PER_ROW = 6
BUCKETS = 1 << 16
BLOCK = 64
STRETCH_CELLS = 1 << 22  # transfer matrix cells that are unfolded at a time
CACHED_WORDS = 400_000
CACHED_PIECES = 400_000
JOINED_SHARE = 4  # one in so many sequences is joined from two languages
WORD = re.compile(r"[^\W\d_]+")


class Codes(dict):
    """Buckets of the features of one kind by their text, computed when first asked for."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED_PIECES:
            self.clear()
        code = self[piece] = zlib.crc32(f"{self.kind}:{piece}".encode()) % BUCKETS
        return code


_AFFIXES = [(n, Codes(f"p{n}"), Codes(f"s{n}")) for n in (1, 2, 3)]
_GRAMS, _LETTERS, _SCRIPTS = Codes("g"), Codes("c"), Codes("b")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-cased word, each once; the same word always has the same."""
    marked = f"^{word}$"
    found = [zlib.crc32(f"w:{word}".encode()) % BUCKETS] if len(word) <= 24 else []
    for n, heads, tails in _AFFIXES:
        found += heads[word[:n]], tails[word[-n:]]
    found += [_GRAMS[g] for g in {marked[i : i + 2] for i in range(len(marked) - 1)}]
    found += [_GRAMS[g] for g in {marked[i : i + 3] for i in range(len(marked) - 2)}]
    if not word.isascii():
        letters = {c for c in word if ord(c) > 127}
        found += [_LETTERS[c] for c in letters]
        found += [_SCRIPTS[str(b)] for b in {ord(c) >> 7 for c in letters}]
    return found


@dataclass
class Chain:
    """Weights of the field: emissions by feature, transitions, start."""

    langs: list[str]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


def _log_norm(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))


def expectations(scores: np.ndarray, live: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Forward-backward over equally long sequences (n, t, k): posteriors, pair and start sums, log Z."""
    n, t, k = scores.shape
    alpha, beta = np.empty((n, t, k)), np.zeros((n, t, k))
    alpha[:, 0] = start + scores[:, 0]
    for i in range(1, t):
        step = _log_norm(alpha[:, i - 1][:, :, None] + move, 1)[:, 0] + scores[:, i]
        alpha[:, i] = np.where(live[:, i, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = _log_norm(move + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2)[:, :, 0]
        beta[:, i] = np.where(live[:, i + 1, None], step, beta[:, i + 1])
    total = _log_norm(alpha[:, -1], 1)[:, 0]
    post = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
    pairs = np.zeros((k, k))
    for i in range(1, t):
        joint = np.exp(alpha[:, i - 1][:, :, None] + move + (scores[:, i] + beta[:, i])[:, None, :] - total[:, None, None])
        pairs += (joint * live[:, i, None, None]).sum(axis=0)
    return post, pairs, post[:, 0].sum(axis=0), total


def joined_pairs(sequences: list[tuple[list[str], list[int]]]) -> list[tuple[list[str], list[int]]]:
    """Sequences that change from one language to another in the middle: one in ``JOINED_SHARE`` is
    followed by the second half of the next one of another language."""
    out = []
    for at in range(0, len(sequences), JOINED_SHARE):
        words, tags = sequences[at]
        other = next((s for s in sequences[at + 1 : at + 1 + 4 * JOINED_SHARE] if s[1][0] != tags[0]), None)
        if other is not None:
            a, b = -(-len(words) // 2), len(other[0]) // 2
            out.append((words[:a] + other[0][b:], tags[:a] + other[1][b:]))
    return out


def train(sequences: list[tuple[list[str], list[int]]], langs: list[str], passes: int = 5, seed: int = 5) -> Chain:
    """Stochastic gradient (adaptive steps) on the conditional log likelihood with a quadratic penalty.

    A sequence is its words and a state for each of them.
    """
    k = len(langs)
    # a small start for staying in a language; both are learned on
    emit, move, start = np.zeros((BUCKETS, k)), np.eye(k) * 0.5, np.zeros(k)
    seen = [np.full_like(a, 1e-3) for a in (emit, move, start)]
    features: dict[str, list[int]] = {}
    rng, batch = np.random.default_rng(seed), 128
    for _ in range(passes):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), batch):
            some = [sequences[i] for i in order[at : at + batch]]
            n, t = len(some), max(len(w) for w, _ in some)
            live, gold = np.zeros((n, t), dtype=bool), np.zeros((n, t, k))
            gold_pairs = np.zeros((k, k))
            place, cols = [], []
            for i, (words, tags) in enumerate(some):
                live[i, : len(words)] = True
                gold[i, np.arange(len(tags)), tags] = 1.0
                np.add.at(gold_pairs, (tags[:-1], tags[1:]), 1.0)
                for j, w in enumerate(words):
                    if w not in features:
                        features[w] = word_features(w)
                    cols += features[w]
                    place += [i * t + j] * len(features[w])
            place_a, cols_a = np.array(place), np.array(cols)
            scores = np.stack([np.bincount(place_a, emit[cols_a, c], n * t) for c in range(k)], axis=1).reshape(n, t, k)
            post, pairs, first, _ = expectations(scores, live, move, start)
            gap = ((post - gold) / n).reshape(n * t, k)
            hot, inverse = np.unique(cols_a, return_inverse=True)
            slope = np.stack([np.bincount(inverse, gap[place_a, c], len(hot)) for c in range(k)], axis=1) + 1e-5 * emit[hot]
            seen[0][hot] += slope**2
            emit[hot] -= 0.3 * slope / np.sqrt(seen[0][hot])
            for s, array, g in ((1, move, (pairs - gold_pairs) / n + 1e-3 * move), (2, start, (first - gold[:, 0].sum(axis=0)) / n)):
                seen[s] += g**2
                array -= 0.1 * g / np.sqrt(seen[s])
    return Chain(langs, emit, move, start)


def _norm(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def _transfers(scores: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transfer matrices of the words in blocks of ``BLOCK``, and the product of each block.

    A word's matrix is exp(move) with its emissions, or, where a chain begins, the start weights
    in every row; the last block is filled up with unit matrices.
    """
    n, k = scores.shape
    blocks = -(-n // BLOCK)
    shape = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.repeat(np.exp(move)[None], blocks * BLOCK, axis=0)
    step[:n][first] = np.exp(start)[None, None, :]
    step[:n] *= shape[:, None, :]
    step[n:] = np.eye(k)
    step = step.reshape(blocks, BLOCK, k, k)
    whole = step[:, 0]
    for i in range(1, BLOCK):
        whole = _norm(whole @ step[:, i], (1, 2))
    return step, whole


def _inside(step: np.ndarray, whole: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the words of a stretch that is entered with one vector and left with the other;
    also the vector with which the stretch before it is left."""
    blocks, _, k, _ = step.shape
    enters, leaves = np.empty((blocks, k)), np.empty((blocks, k))
    v = enter
    for b in range(blocks):
        enters[b] = v
        v = _norm(v @ whole[b], 0)
    v = leave
    for b in range(blocks - 1, -1, -1):
        leaves[b] = v
        v = _norm(whole[b] @ v, 0)
    back = v
    ahead, behind = np.empty((blocks, BLOCK, k)), np.empty((blocks, BLOCK, k))
    v = enters
    for i in range(BLOCK):
        v = _norm(np.einsum("bj,bjk->bk", v, step[:, i]), (1,))
        ahead[:, i] = v
    v = leaves
    for i in range(BLOCK - 1, -1, -1):
        behind[:, i] = v
        v = _norm(np.einsum("bjk,bk->bj", step[:, i], v), (1,))
    return _norm((ahead * behind).reshape(-1, k), (1,)), back


def stretches(n: int, k: int) -> list[tuple[int, int]]:
    width = max(1, STRETCH_CELLS // (k * k * BLOCK)) * BLOCK
    return [(at, min(n, at + width)) for at in range(0, n, width)]


def posteriors_backwards(scores_of, first: np.ndarray, move: np.ndarray, start: np.ndarray):
    """(from, to, posteriors) of the stretches of many chains laid end to end, the last one first.

    ``first`` marks the words that begin a chain, ``scores_of(from, to)`` gives their emissions. A
    first pass keeps the vector with which each stretch is entered; matrices are unfolded anew in
    the second, so memory does not grow with the number of words.
    """
    k, parts = len(start), stretches(len(first), len(start))
    enters = [np.full(k, 1.0 / k)]
    held = None
    for a, b in parts:
        held = _transfers(scores_of(a, b), first[a:b], move, start)
        v = enters[-1]
        for whole in held[1]:
            v = _norm(v @ whole, 0)
        enters.append(v)
    leave = np.ones(k)
    for nth in range(len(parts) - 1, -1, -1):
        a, b = parts[nth]
        held = held if nth == len(parts) - 1 else _transfers(scores_of(a, b), first[a:b], move, start)
        post, leave = _inside(*held, enters[nth], leave)
        yield a, b, post[: b - a]


def posteriors(scores: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior of each state for every word of many chains laid end to end."""
    out = np.empty(scores.shape)
    for a, b, post in posteriors_backwards(lambda a, b: scores[a:b], first, move, start):
        out[a:b] = post
    return out


class Labeller:
    """Predicts with a trained chain; emissions of words seen before come from a bounded table,
    which a worker keeps from task to task."""

    @classmethod
    def of(cls, key: str, chain: Chain) -> "Labeller":
        return kept(key, lambda: cls(chain))

    def __init__(self, chain: Chain):
        self.chain = chain
        self.weights = chain.emit.astype(np.float32)
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(chain.langs)), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        """Emissions of words not met before, all at once."""
        listed = [word_features(w) for w in words]
        ends = np.cumsum([len(f) for f in listed])
        flat = np.fromiter((c for f in listed for c in f), np.int64, int(ends[-1]))
        at = len(self.place)
        while at + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for begin in range(0, len(words), 4096):
            end = min(len(words), begin + 4096)
            low = int(ends[begin - 1]) if begin else 0
            cut = np.concatenate([[0], ends[begin : end - 1] - low]).astype(np.int64)
            self.rows[at + begin : at + end] = np.add.reduceat(self.weights[flat[low : int(ends[end - 1])]], cut, axis=0)
        self.place.update(zip(words, range(at, at + len(words))))

    def _places(self, text: str) -> np.ndarray:
        """Row numbers of the emissions of a text's words."""
        words = WORD.findall(text.lower())
        fresh = list(dict.fromkeys(w for w in words if w not in self.place))
        for at in range(0, len(fresh), 8192):
            self._learn(fresh[at : at + 8192])
        return np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))

    def _chains(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of every word, marks of the first words, number of words of each text)."""
        if len(self.place) > CACHED_WORDS:
            self.place = {}
        each = [self._places(t or "") for t in texts]
        counts = np.array([len(e) for e in each], dtype=np.int64)
        rows = np.concatenate([np.zeros(0, np.int32), *each])
        first = np.zeros(len(rows), dtype=bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        return rows, first, counts

    def word_posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors of all words, number of words of each text)."""
        rows, first, counts = self._chains(texts)
        return posteriors(self.rows[rows].astype(np.float64), first, self.chain.move, self.chain.start), counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows, first, counts = self._chains(texts)
        owner = np.repeat(np.arange(len(counts)), counts)
        k = len(self.chain.langs)
        sums = np.zeros((len(counts), k))
        for a, b, post in posteriors_backwards(lambda a, b: self.rows[rows[a:b]].astype(np.float64), first, self.chain.move, self.chain.start):
            for c in range(k):
                sums[:, c] += np.bincount(owner[a:b], post[:, c], len(counts))
        mean = sums / np.maximum(counts, 1)[:, None]
        best = mean.argmax(axis=1)
        langs = [self.chain.langs[b] if c else UNKNOWN for b, c in zip(best, counts)]
        return langs, [float(min(1.0, max(0.0, m[b]))) if c else 0.0 for m, b, c in zip(mean, best, counts)]


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain | None:
    """Train on at most ``sample_rows`` rows (smallest hashes of doc_id) whose remainder is not 1.

    From each sampled text come ``SEQUENCES_PER_ROW`` sequences of ``SEQUENCE`` words, spread over
    the whole text; that is what the driver receives.
    """
    known = docs.filter(F.col("lang").isNotNull() & learned_from((0, 2), 3)).select("doc_id", "text", "lang")
    # every language gets its share of the sample
    by_lang = saved(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    langs = sorted(r["lang"] for r in by_lang.collect())
    if not langs:
        return None
    each = max(1, sample_rows // len(langs))
    # ids alone are drawn: those with the smallest hashes, looked for among about twice as many as are wanted
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)
    few = known.select("doc_id", "lang").join(F.broadcast(by_lang), "lang").filter(draw * F.col("n") < 2 * each).select("doc_id", "lang").distinct()
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = saved(few.withColumn("_n", F.row_number().over(turn)).filter(F.col("_n") <= each).drop("_n"), "language-ids")
    # at most sample_rows ids go to every task, and as many texts come back
    drawn = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.max("text").alias("text"))

    def cut(batches):
        for batch in batches:
            out = {"words": [], "lang": []}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                words = WORD.findall((text or "").lower())
                n = -(-len(words) // SEQUENCE)
                # spread evenly over the whole text, its last words included
                for i in sorted({round(j * (n - 1) / (SEQUENCES_PER_ROW - 1)) for j in range(SEQUENCES_PER_ROW)} if n else ()):
                    out["words"].append(words[i * SEQUENCE : (i + 1) * SEQUENCE])
                    out["lang"].append(lang)
            yield out

    rows = map_batches(drawn.select("text", "lang"), cut, "words array<string>, lang string").collect()
    place = {lang: i for i, lang in enumerate(langs)}
    found = sorted((zlib.crc32(" ".join(r["words"]).encode()), list(r["words"]), place[r["lang"]]) for r in rows)
    sequences = [(words, [tag] * len(words)) for _, words, tag in found]
    return train(sequences + joined_pairs(sequences), langs) if sequences else None


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    chain = fit(docs, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if chain is None:
        return rows.select("doc_id", hold_out(1, 3).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent, key = docs.sparkSession.sparkContext.broadcast(chain), f"language-{uuid.uuid4().hex}"

    def work(batches):
        labeller = Labeller.of(key, sent.value)
        for batch in batches:
            langs, scores = labeller.predict(batch["text"].to_pylist())
            yield {"doc_id": batch["doc_id"], "lang_pred": langs, "score": scores}

    found = map_batches(rows, work, "doc_id long, lang_pred string, score double", key)
    return found.select("doc_id", hold_out(1, 3).alias("held_out"), "lang_pred", "score")
