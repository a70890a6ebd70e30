"""Toxicity (9): subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the embeddings of its hashed character n-grams (3 to 5 and the whole, with word ends), a document the
average of its ``TOP`` most toxic words, and the softmax of a linear map of that is its score: length does not dilute, a word
counts alike wherever it stands, and one chance resemblance weighs less than several. Misspelt and inflected words share n-grams
with known ones. Which words are a document's most toxic the model itself says; they are chosen anew, from all words of the
whole text, every ``every`` steps of the training, and at first by how peculiar their n-grams are to toxic documents.

Trained on a bounded sample: at most ``most_each`` toxic and twice as many other labelled documents outside the held-out
fold, of smallest id hash among those of at most ``longest`` characters. Whole texts teach and are scored. Since map and averages
are linear, each n-gram has one number after training and a document's score needs only means of them.

Null and wordless texts score 0; an empty table gives no rows; repeated rows score alike and teach once; without labels of both
classes every score is 0; of equally toxic words any may count, which does not change the score. Columns other than id and text
are not read, and ids are passed on as they are.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import is_held_out, map_rows, one_model, small_batches
from siftwell.llm.wordhash import LETTER, NUMBER, WordTable, char_classes, code_points, mixed, span_hashes, spread, words_between

TOP, BUCKETS, DIM = 3, 1 << 16, 4
#: N-grams over which a word's embedding is averaged at least: those that a short word lacks are neutral ones.
LEAST_GRAMS = 24
THRESHOLD = 0.7


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, starts, lengths of the lower-cased words (letters and digits), and each text's first word."""
    cp, ends = code_points([t.lower() for t in texts])
    kind = char_classes()[cp]
    return cp, *words_between((kind != LETTER) & (kind != NUMBER), ends)


def ngrams(cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the given words, word by word, and how many each word has."""
    size = lengths + 2
    joined = np.empty(int(size.sum()), np.uint64)
    begin = np.cumsum(size) - size
    joined[begin], joined[begin + size - 1] = 2, 3  # word ends
    inner = np.ones(len(joined), bool)
    inner[begin] = inner[begin + size - 1] = False
    joined[inner] = cp[spread(starts, lengths)]
    values = mixed((joined + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    left = np.repeat(begin + size, size) - np.arange(len(joined))  # characters to the word's end, this one included
    owner = np.repeat(np.arange(len(starts)), size)
    place = (np.arange(len(joined)) - np.repeat(begin, size)).astype(np.uint64)
    whole = np.add.reduceat(mixed(values + place * np.uint64(0xC2B2AE3D27D4EB4F)), begin) if len(begin) else values
    found, of = [(mixed(whole) & np.uint64(BUCKETS - 1)).astype(np.int64)], [np.arange(len(starts))]
    for n in (3, 4, 5):
        ok = np.flatnonzero(left >= n)
        h = values[ok] * np.uint64(2 * n + 1)
        for j in range(1, n):
            h = mixed(h) + values[ok + j] * np.uint64(2 * (n + j) + 1)
        found.append((mixed(h) & np.uint64(BUCKETS - 1)).astype(np.int64))
        of.append(owner[ok])
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return found[order], np.bincount(of, minlength=len(starts))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``counts`` values (rows); every run has at least one."""
    return np.add.reduceat(values, np.cumsum(counts) - counts, axis=0) if len(counts) else values[:0]


def top_words(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the ``TOP`` greatest values of each run that begins at ``at`` (one more entry: the end), run by run."""
    size = np.diff(at)
    run = np.repeat(np.arange(len(size)), size)
    left, chosen = np.arange(len(values)), []
    for _ in range(TOP):
        if not len(left):
            break
        owner = run[left]
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        most = np.maximum.reduceat(values[left], begin)
        hits = np.flatnonzero(values[left] == np.repeat(most, np.diff(np.r_[begin, len(left)])))
        hits = hits[np.r_[True, owner[hits][1:] != owner[hits][:-1]]]  # the first of equal ones
        chosen.append(left[hits])
        left = np.delete(left, hits)
    return np.sort(np.concatenate(chosen)) if chosen else left


def train(texts: list[str], toxic: list[int], rounds: int = 70, every: int = 5, rate: float = 0.12, lift: float = 2.0, decay: float = 1e-4, smooth: float = 0.015, seed: int = 7) -> tuple[np.ndarray, float]:
    """One number for each n-gram bucket, and a bias: what the jointly trained embeddings and softmax come to."""
    if not any(toxic) or all(toxic):
        return np.zeros(BUCKETS), -np.inf
    random = np.random.default_rng(seed)
    toxic_of = np.array(toxic)
    cp, starts, lengths, at = words_of(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    _, place, word = np.unique(span_hashes(cp, starts, lengths), return_index=True, return_inverse=True)
    grams, n_grams = ngrams(cp, starts[place], lengths[place])
    used, gram = np.unique(grams, return_inverse=True)
    first = np.cumsum(n_grams) - n_grams
    table = random.normal(0, 0.1, (len(used), DIM))
    out = np.c_[-np.ones(DIM), np.ones(DIM)] * 1.5 + random.normal(0, 0.1, (DIM, 2))
    bias = np.array([2.0, -2.0])  # most texts are not toxic: ordinary words need not be pushed down for that
    # at first words count by their n-grams' odds in toxic documents, at equal numbers of both kinds, with enough smoothing that a rare n-gram is not peculiar
    pairs = np.unique(doc * len(place) + word)
    of_word = np.repeat(np.arange(len(place)), n_grams)
    df = [np.bincount(pairs[toxic_of[pairs // len(place)] == k] % len(place), minlength=len(place)) for k in (0, 1)]
    odds = [np.log(np.bincount(gram, n[of_word], len(used)) * toxic_of.sum() / (toxic_of == k).sum() + 1 + smooth * toxic_of.sum()) for k, n in enumerate(df)]
    value = sums((odds[1] - odds[0])[gram], n_grams) / np.maximum(LEAST_GRAMS, n_grams)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, out, bias)]
    with_words = np.flatnonzero(np.diff(at))
    y = toxic_of[with_words].astype(float)
    weight = np.where(y > 0, lift, 1.0) / len(texts)
    for step in range(1, rounds + 1):
        if (step - 1) % every == 0:
            if step > 1:
                value = sums((table @ (out[:, 1] - out[:, 0]))[gram], n_grams) / np.maximum(LEAST_GRAMS, n_grams)
            taken = top_words(value[word], at)
            count = np.bincount(doc[taken], minlength=len(texts))[with_words]
            seen, at_word = np.unique(word[taken], return_inverse=True)
            its, n_its = gram[spread(first[seen], n_grams[seen])], n_grams[seen]
            inverse = 1 / np.maximum(LEAST_GRAMS, n_its)[:, None]
            gram_word, word_doc = np.repeat(np.arange(len(seen)), n_its), np.repeat(np.arange(len(with_words)), count)
        mean = sums((sums(table[its], n_its) * inverse)[at_word], count) / count[:, None]
        logits = mean @ out + bias
        slope = (1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -50, 50))) - y) * weight
        both = np.c_[-slope, slope]
        d_mean = (both @ out.T) / count[:, None]
        d_word = np.stack([np.bincount(at_word, d_mean[word_doc, k], len(seen)) for k in range(DIM)], axis=1) * inverse
        d_table = np.stack([np.bincount(its, d_word[gram_word, k], len(used)) for k in range(DIM)], axis=1) + decay * table
        for x, d, (m, v) in ((table, d_table, moments[0]), (out, mean.T @ both, moments[1]), (bias, both.sum(axis=0), moments[2])):
            m *= 0.9
            m += 0.1 * d
            v *= 0.99
            v += 0.01 * d * d
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    value = np.zeros(BUCKETS)
    value[used] = table @ (out[:, 1] - out[:, 0])
    return value, float(bias[1] - bias[0])


class Scorer:
    """Scores whole texts; each new word's number is computed once and kept."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias, self.table = value, bias, WordTable(most=500_000)
        self._forget()

    def _forget(self) -> None:
        self.words = np.zeros(1 << 16)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in small_batches(texts):
            cp, starts, lengths, at = words_of(texts[a:b])
            if not len(starts) or not np.isfinite(self.bias):
                continue

            def learn(places: np.ndarray, base: int, cp=cp, starts=starts, lengths=lengths) -> None:
                while base + len(places) > len(self.words):
                    self.words = np.r_[self.words, np.zeros_like(self.words)]
                grams, n = ngrams(cp, starts[places], lengths[places])
                self.words[base : base + len(places)] = sums(self.value[grams], n) / np.maximum(LEAST_GRAMS, n)

            rows = self.table.resolve(span_hashes(cp, starts, lengths), learn, self._forget)
            each = self.words[rows]
            doc = np.repeat(np.arange(b - a), np.diff(at))
            taken = top_words(each, at)
            count = np.bincount(doc[taken], minlength=b - a)
            total = np.bincount(doc[taken], each[taken], b - a)
            out[a:b] = np.where(count > 0, 1 / (1 + np.exp(np.clip(-(total / np.maximum(1, count) + self.bias), -700, 700))), 0.0)
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, most_each: int = 500, longest: int = 20_000) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most_each`` toxic and twice as many other documents of at most ``longest`` characters.

    Of rows that share an id one teaches, so no more than 3 * ``most_each`` texts come to the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # ids are ranked without their texts; the few chosen ones then fetch theirs
    fine = docs.where(F.length("text") <= longest)
    usable = usable.join(fine.select("doc_id"), "doc_id", "left_semi")
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
    most = F.when(F.col("toxic") == 1, most_each).otherwise(2 * most_each)
    chosen = usable.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))).withColumn("r", rank("toxic", "salt")).where((F.col("r") <= 2 * most_each) & (F.col("r") <= most))
    chosen = chosen.withColumn("r", rank("toxic")).where((F.col("r") <= 2 * most_each) & (F.col("r") <= most)).select("doc_id", "toxic")
    got = fine.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in got], [r["toxic"] for r in got]


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    value, bias = model
    packed = pickle.dumps((value.astype(np.float32), bias))

    def make():
        scorer = one_model(("toxicity", packed), lambda: Scorer(*pickle.loads(packed)))

        def run(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            found = scorer.score([t or "" for t in texts])
            return found, (found >= threshold).astype(np.int32)

        return run

    return map_rows(docs, [F.col("doc_id").cast("long").alias("doc_id")], ["text"], "score double, predicted int", make)
