"""Token counts under a unigram model, computed on a trie of distinct pre-tokens.

A pre-token is a run of non-blank characters behind a word-start mark. Its tokens are those of
the segmentation with the greatest sum of scores (forward pass of a unigram model; ties go to
fewer tokens). The best score at a character depends on the characters before it only, so words
with a common prefix share it: distinct pre-tokens are inserted in a trie, each node computes its
forward score once, and the node where a pre-token ends stores its number of tokens.

A task holds the trie of its own partition: texts are read once, nothing is shuffled, and a trie
that reaches ``MAX_NODES`` is begun anew, also inside a text, which bounds memory and changes no
count. A pre-token of more than ``LONG_WORD`` characters (a text without blanks) shares its first
``LONG_WORD`` places with others; behind them the same recurrence keeps the scores of as many places
as the longest piece has, whatever the length.

Scores follow from the vocabulary's order: the piece of rank r has log probability -ln(r + 2)
up to a constant (Zipf's rule); a character no piece covers costs one token per UTF-8 byte.
Defined cases: null and blank texts have zero tokens; very long texts and pre-tokens are counted whole; a null or repeated doc_id keeps its row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelinekit.llm.common import map_batches

WORD_START = "▁"
MAX_NODES = 1_500_000
LONG_WORD = 4_096
BYTE_PENALTY = 4.0


def piece_scores(model_path: str) -> dict[str, float]:
    """Piece to score of a sentencepiece vocabulary; control and byte pieces take no part."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return {model.id_to_piece(i): -float(np.log(r + 2)) for r, i in enumerate(plain)}


class Trie:
    """Distinct pre-tokens; a node is an index into flat lists."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES, long_word: int = LONG_WORD):
        self.scores, self.max_nodes, self.long_word = scores, max_nodes, long_word
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - BYTE_PENALTY
        # suffixes worth trying end with the node's character; most characters end only short pieces
        self.lengths: dict[str, list[int]] = {}
        for piece in scores:
            self.lengths.setdefault(piece[-1], set()).add(len(piece))  # type: ignore[union-attr]
        self.lengths = {c: sorted(n) for c, n in self.lengths.items()}
        self.reset()

    def reset(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a pre-token (given without its mark)."""
        known = self.terminal.get(word)
        return self.insert(word) if known is None else known

    def insert(self, word: str) -> int:
        if len(self.best) > self.max_nodes:
            self.reset()
        text = WORD_START + word
        path, node = [0], 0
        children, best, tokens = self.children, self.best, self.tokens
        for end, char in enumerate(text[: self.long_word], 1):
            child = children[node].get(char)
            if child is None:
                back = path[-1]
                top, used = self._step(text, end, best[back], tokens[back], lambda n: (best[path[end - n]], tokens[path[end - n]]))
                child = len(best)
                children[node][char] = child
                children.append({})
                best.append(top)
                tokens.append(used)
            path.append(child)
            node = child
        if len(text) > self.long_word:
            return self._run_on(text, [(best[n], tokens[n]) for n in path[-self.longest :]])
        self.terminal[word] = tokens[node]
        return tokens[node]

    def _step(self, text: str, end: int, before: float, used_before: int, at: Callable[[int], tuple[float, int]]) -> tuple[float, int]:
        """Best score and tokens of the first ``end`` characters; ``at(n)`` are those ``n`` characters earlier."""
        size = len(text[end - 1].encode())
        top, used = before + self.unknown * size, used_before + size
        for n in self.lengths.get(text[end - 1], ()):
            if n > end:
                break
            score = self.scores.get(text[end - n : end])
            if score is not None:
                earlier, count = at(n)
                total = earlier + score
                if total > top or total == top and count + 1 < used:
                    top, used = total, count + 1
        return top, used

    def _run_on(self, text: str, recent: list[tuple[float, int]]) -> int:
        """Tokens of a long pre-token from the scores at its last places in the trie, which are not kept."""
        places = deque(recent, maxlen=self.longest)
        for end in range(self.long_word + 1, len(text) + 1):
            places.append(self._step(text, end, *places[-1], lambda n: places[-n]))
        return places[-1][1]


def _count(batches, scores):
    trie = Trie(scores.value)
    for batch in batches:
        totals, pretokens = [], []
        for text in batch["text"].to_pylist():
            words = Counter((text or "").split())
            totals.append(sum(n * trie.count(w) for w, n in words.items()))
            pretokens.append(sum(words.values()))
        yield {"doc_id": batch["doc_id"], "n_pretokens": pretokens, "n_tokens": totals}


def token_counts(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row. ``scores`` is a vocabulary, so of bounded size."""
    sent = docs.sparkSession.sparkContext.broadcast(scores)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, partial(_count, scores=sent), "doc_id long, n_pretokens long, n_tokens long")
