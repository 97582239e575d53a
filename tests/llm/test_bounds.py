"""Very long inputs: time and memory that follow the input, files of bounded size."""

import random
import time

from pyspark.sql import functions as F

from timelinekit.llm import pii, token_counts


# 8 personal data
def test_many_matches_in_one_text(spark):
    line = "call 555-123-4567 or 1.2.3.4, IBAN GB82 WEST 1234 5698 7654 32. "
    n = 20_000
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(line), n).alias("text"))
    begun = time.monotonic()
    row = pii.personal_data(docs).first()
    assert time.monotonic() - begun < 40
    assert (row.n_ip, row.n_iban, row.n_local_phone) == (n, n, n)
    spans = row.spans.split(",")
    for i in (0, 1, 255, 256, 257, n - 1):
        at = i * len(line)
        assert spans[3 * i : 3 * i + 3] == [f"local_phone:{at + 5}:{at + 17}", f"ip:{at + 21}:{at + 28}", f"iban:{at + 35}:{at + 62}"]


def test_context_moves_the_score(spark):
    texts = ["write to a@b.cd", "see a@b.cd", "dummy a@b.cd", "ssn 123-45-6789", "ssn example 123-45-6789", "Telefon 555-123-4567", "x" * 300 + " call 555-123-4567"]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.spans, None if r.top_score is None else round(r.top_score, 3)) for r in rows}
    assert got == {
        0: ("email:9:15", 1.0), 1: ("email:4:10", 0.9), 2: ("email:6:12", 0.6), 3: ("ssn:4:15", 0.7), 4: ("", None),
        5: ("local_phone:8:20", 0.7), 6: ("local_phone:306:318", 0.7),
    }


# 4 token counts
def test_tries_cut_inside_texts_and_words(spark):
    pick = random.Random(3)
    scores = {c: -pick.uniform(1, 4) for c in "abc" + token_counts.WORD_START}
    scores |= {"".join(pick.choices("abc", k=pick.randint(2, 9))): -pick.uniform(1, 6) for _ in range(40)}
    whole, cut = token_counts.Trie(scores, 10**9, 10**9), token_counts.Trie(scores, 50, 12)
    for _ in range(1_000):
        word = "".join(pick.choices("abcd", k=pick.randint(0, 60)))
        assert whole.count(word) == cut.count(word)
        assert len(cut.best) <= 50 + 12
    # a text without blanks leaves no more nodes than its first places
    trie = token_counts.Trie(scores)
    text = "abcd" * 50_000
    assert trie.count(text) == token_counts.Trie(scores, 10**9, 10**9).count(text)
    assert len(trie.best) <= token_counts.LONG_WORD + 1
    docs = spark.createDataFrame([(1, text), (2, "ab " + text)], "doc_id long, text string")
    one, two = token_counts.token_counts(docs, scores).orderBy("doc_id").collect()
    assert (one.n_pretokens, two.n_pretokens, two.n_tokens - one.n_tokens) == (1, 2, whole.count("ab"))
