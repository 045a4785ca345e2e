"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy is trained from texts confirmed as toxic and from unlabelled texts. With class prior c,
sigmoid-shaped losses and R+p, R-p, R-u the mean losses of positives as positive, positives as negative and unlabelled
as negative, the risk is c R+p + max(0, R-u - c R-p): the second part, the risk of the negatives, can't fall below
zero; where a step would make it so, the step goes the other way. Features say which words a text has, and which
beginnings of words, so that a stem is known by endings not seen yet; those are kept as features that part positives
from unlabelled texts beyond chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import textvec as tv
from lattica.llm.tables import digest_of, without, written

#: Texts that a model is trained on at most: confirmed ones, and unlabelled ones; the bytes of them together, and of one.
MOST_POSITIVE, MOST_UNLABELLED, MOST_BYTES, LONGEST = 3000, 9000, 64 << 20, 1 << 20
#: Bytes of text that the driver works on at once.
DRIVER_SLICE = 1 << 17
#: Positives that a word must be in to be looked at.
LEAST_TEXTS = 3
#: Lengths in bytes of the beginnings of longer words that are features as well.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
#: Cross-validation: parts of the training texts, and steps of each fit.
FOLDS, SHORT = 3, 150


class Setting(NamedTuple):
    """surprise: how much commoner in positives than by chance a feature must be, as twice its log likelihood ratio.

    slack: how many times as many unlabelled texts may have it as if it were in toxic texts only. stems: whether
    beginnings of words count.
    """

    surprise: float
    slack: float
    stems: bool


#: What cross-validation chooses from; of equally good ones the first.
SETTINGS = [Setting(surprise, slack, stems) for stems in (True, False) for slack in (1.5, 4.0) for surprise in (20.0, 10.0, 40.0)]


def word_sets(column: pa.Array, beginnings: tuple[int, ...] = BEGINNINGS, most: int = tv.SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a column: first row, rows, and the sorted distinct (row, hash) of words and their beginnings."""
    data, at = tv.buffers(column)
    for i, j in tv.slices(at, most):
        part = data[at[i] : at[j]]
        row, start, end = tv.spans(part, at[i : j + 1] - at[i], tv.NO_LETTER)
        rows, starts, ends, kinds = [row], [start], [end], [np.zeros(len(row), np.uint64)]
        for n in beginnings:
            use = end - start > n
            rows.append(row[use])
            starts.append(start[use])
            ends.append(start[use] + n)
            kinds.append(np.full(use.sum(), n, np.uint64))
        row = np.concatenate(rows)
        found = tv.mix(tv.hashes(part, np.concatenate(starts), np.concatenate(ends)) + np.concatenate(kinds))
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
        yield i, j - i, row[new], found[new]


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: CRC-32 of doc_id as text, modulo 3, is 1. A null doc_id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


class Model:
    """Sorted word hashes with weights, and a bias; the score is the logistic function of their sum."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, n, row, word in word_sets(column):
            z = np.full(n, self.bias)
            if len(self.words):
                at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
                hit = self.words[at] == word
                z += np.bincount(row[hit], self.weights[at[hit]], n)
            out[i : i + n] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Features(NamedTuple):
    """Texts as (row, place in the vocabulary), the features that positives have; stem: which of those are beginnings only."""

    vocabulary: np.ndarray
    stem: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]  # of positives and of unlabelled texts
    n: tuple[int, int]

    def some(self, rows: list[np.ndarray]) -> Features:
        """The same with some rows (a mask for each part)."""
        parts = []
        for (r, f), use in zip(self.parts, rows):
            hit = use[r]
            parts.append(((np.cumsum(use) - 1)[r[hit]].astype(np.int32), f[hit]))
        return self._replace(parts=parts, n=tuple(int(u.sum()) for u in rows))


def features(positive: pa.Array, unlabelled: pa.Array, prior: float) -> Features:
    """In small slices, so that the driver holds little, and without words that are in few positives or far too common.

    Too common: in over twice as many unlabelled texts as any setting allows for a feature, and ten.
    """

    def often(beginnings: tuple[int, ...]) -> np.ndarray:
        """Sorted words of at least LEAST_TEXTS positives; counters by hash first tell those that can't be."""
        counters = np.zeros(1 << 20, np.uint32)
        for *_, word in word_sets(positive, beginnings, DRIVER_SLICE):
            np.add.at(counters, (word >> np.uint64(44)).astype(np.int64), np.uint32(1))
        kept = [word[counters[(word >> np.uint64(44)).astype(np.int64)] >= LEAST_TEXTS] for *_, word in word_sets(positive, beginnings, DRIVER_SLICE)]
        names, count = np.unique(np.concatenate([*kept, np.zeros(0, np.uint64)]), return_counts=True)
        return names[count >= LEAST_TEXTS]

    vocabulary, whole = often(BEGINNINGS), often(())

    def known(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, _, row, word in word_sets(column, most=DRIVER_SLICE):
            at = np.minimum(np.searchsorted(vocabulary, word), max(len(vocabulary) - 1, 0))
            hit = vocabulary[at] == word if len(vocabulary) else np.zeros(len(word), bool)
            yield (first + row[hit]).astype(np.int32), at[hit].astype(np.int32)

    n, counts = (len(positive), len(unlabelled)), [np.zeros(len(vocabulary)), np.zeros(len(vocabulary))]
    for count, column in zip(counts, (positive, unlabelled)):
        for _, f in known(column):
            np.add.at(count, f, 1)
    pure = counts[0] / n[0] * prior * n[1]
    vocabulary = vocabulary[counts[1] < 10 + 2 * (max(x.slack for x in SETTINGS) * pure + 2 * np.sqrt(pure))]
    none = np.zeros(0, np.int32)
    parts = [tuple(map(np.concatenate, zip((none, none), *known(column)))) for column in (positive, unlabelled)]
    return Features(vocabulary, ~np.isin(vocabulary, whole), parts, n)


def chosen(x: Features, prior: float, setting: Setting) -> np.ndarray:
    """Places of the features that part positives from unlabelled texts."""
    n = x.n
    count_p, count_u = (np.bincount(f, minlength=len(x.vocabulary)) for _, f in x.parts)
    expected = (count_p + count_u) * (n[0] / (n[0] + n[1]))
    surprise = 2 * (count_p * np.log(np.maximum(count_p, 1) / np.maximum(expected, 1e-300)) - count_p + expected)
    # a word of toxic texts only is prior times as common among unlabelled texts as among positives
    pure = count_p / n[0] * prior * n[1]
    use = (count_p >= LEAST_TEXTS) & (surprise > setting.surprise) & (count_p > expected) & (count_u < setting.slack * pure + 2 * np.sqrt(pure))
    return np.flatnonzero(use & (setting.stems | ~x.stem))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative risk of outputs under the logistic loss."""
    return float(prior * np.logaddexp(0, -positive).mean() + max(0.0, np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()))


def outputs(x: Features, use: np.ndarray, w: np.ndarray, bias: float) -> list[np.ndarray]:
    """What the classifier of some features says of the positives and of the unlabelled texts."""
    weight = np.zeros(len(x.vocabulary))
    weight[use] = w
    return [np.bincount(r, weight[f], n) + bias for (r, f), n in zip(x.parts, x.n)]


def fitted(x: Features, prior: float, setting: Setting, steps: int, rate: float = 0.05, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights (none negative) and bias of least non-negative risk, by Adam over all texts at each step."""
    use = chosen(x, prior, setting)
    place = np.full(len(x.vocabulary), -1)
    place[use] = np.arange(len(use))
    parts = [(r[place[f] >= 0], place[f[place[f] >= 0]]) for r, f in x.parts]
    n, k = x.n, len(use)
    w, bias = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)

    def gradient(part: int, by_output: np.ndarray) -> np.ndarray:
        r, f = parts[part]
        return np.append(np.bincount(f, by_output[r], k), by_output.sum())

    for step in range(1, steps + 1 if k else 1):
        zp, zu = (np.bincount(r, w[f], n[i]) + bias for i, (r, f) in enumerate(parts))
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # losses: softplus(-z) as positive, softplus(z) as negative
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_positive = prior * gradient(0, (sp - 1) / n[0])
        of_negative = gradient(1, su / n[1]) - prior * gradient(0, sp / n[0])
        g = as_positive + of_negative if negative >= 0 else -of_negative
        g[:k] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = np.maximum(w - move[:k], 0), bias - move[k]
    return use, w, bias


def best_setting(x: Features, prior: float) -> Setting:
    """The setting of least risk, summed over folds of the training texts, each judged by fits to the others."""
    folds = [np.arange(n) % FOLDS for n in x.n]
    if min(x.n) < 2 * FOLDS:
        return SETTINGS[0]
    total = []
    for setting in SETTINGS:
        total.append(0.0)
        for k in range(FOLDS):
            train, test = x.some([f != k for f in folds]), x.some([f == k for f in folds])
            total[-1] += risk(*outputs(test, *fitted(train, prior, setting, SHORT)), prior)
    return SETTINGS[int(np.argmin(np.round(total, 6)))]


def train(positive: pa.Array, unlabelled: pa.Array, prior: float, steps: int = 800) -> Model:
    """The classifier of least risk, with the setting that cross-validation within these texts finds best.

    Without positives or unlabelled texts, or without any feature, every score is the prior's.
    """
    prior = float(np.clip(prior, 1e-3, 0.9))
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not len(positive) or not len(unlabelled):
        return flat
    x = features(positive, unlabelled, prior)
    use, w, bias = fitted(x, prior, best_setting(x, prior), steps)
    return Model(x.vocabulary[use], w, bias) if len(use) else flat


def learned(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, most_bytes: int = MOST_BYTES, longest: int = LONGEST) -> Model:
    """A model from the rows of docs that aren't held out; the class prior is the share of toxic ones among labels.

    The texts brought to the driver are of at most longest bytes each, and at most about most_positive and
    most_unlabelled, or fewer where they would come to more than about most_bytes; they are picked by doc_id's hash.
    """
    own = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", "toxic").distinct()
    n, toxic = own.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    some = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    total, size = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    fits = most_bytes / max(size / max(total, 1), 1) / (most_positive + most_unlabelled)
    share = lambda most, of: min(1.0, most * min(1.0, fits) / max(of, 1))
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    confirmed = own.filter("toxic = 1").filter(dealt < share(most_positive, toxic)).select("doc_id").distinct()
    positive = some.join(F.broadcast(confirmed), "doc_id", "left_semi").orderBy("doc_id", "text").select("text").toArrow()
    unlabelled = some.filter(dealt < share(most_unlabelled, total)).orderBy("doc_id", "text").select("text").toArrow()
    one = lambda t: t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string())
    return train(_single(one(positive)), _single(one(unlabelled)), toxic / max(n, 1))


def _single(a) -> pa.Array:
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id by default), score from 0 to 1 and predicted (1 if score is at least THRESHOLD).

    Null text counts as empty and has the score of a text without any feature; texts are read whole; rows that repeat
    stay; no rows give none; columns not kept can't clash.
    """
    keep = keep or ["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.bias))  # bounded by training texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in batches:
            score = m.scores(b["text"])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with all their columns, without the rows that a model learned from them predicts to be toxic.

    Each row is judged by itself: rows that share a doc_id, null too, are told apart by their texts.
    """
    digest = digest_of(docs["text"])
    rows = docs.select(F.col("doc_id").alias("_id"), digest.alias("_digest"), "text")
    gone = scored(rows, learned(docs, labels), ["_id", "_digest"]).filter("predicted = 1").select("_id", "_digest").distinct()
    return without(docs, written(gone, "toxic"), digest)
