"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic over hashed
features of its words; the document's is the noisy-or of its sentences. Only
documents have labels: the gradient of the noisy-or shares a toxic document's
label out among its sentences, so that the offending ones are found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches
from .units import LETTER, Hasher, flat, slices, words
from .wordfeatures import lowered, word_features

DIM = 1 << 17
HEADS, TAILS = (3, 4, 5, 6), (4,)
#: At most so many labelled documents of each class are learned from.
PER_CLASS = (2000, 4000)
#: Features are learned for if their log-likelihood ratio, by documents of either class, reaches this.
LEAST_RATIO = 18.0
#: Longer texts are not learned from (they are scored like others), so that the sample has a bound in bytes.
SAMPLE_BYTES = 64 << 10
#: Bytes of text that are learned from, of toxic documents and of others.
CLASS_BYTES = (8 << 20, 16 << 20)
SEED = 41
_BREAK = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def _read(column: pa.Array, h: Hasher):
    """Features of the distinct words; each word's number among them; each word's
    sentence; each text's sentences (n + 1); each sentence's bytes."""
    raw, off = flat(column)
    low = lowered(raw)
    a, b, _ = words(low, off, LETTER)
    p = h.prefix(h.of_byte[low])
    _, first, which = np.unique(h.span(p, a, b), return_index=True, return_inverse=True)
    feats = word_features(h, p, a[first], b[first], DIM, HEADS, TAILS)
    # A sentence ends after a break and at the end of a text.
    stop = _BREAK[raw].copy() if len(raw) else np.zeros(0, dtype=bool)
    ends = off[1:][off[1:] > off[:-1]] - 1
    stop[ends] = True
    ends = np.flatnonzero(stop) + 1
    sentence = np.searchsorted(ends, a, side="right")
    at = np.searchsorted(ends, off[:-1], side="right")
    at = np.append(at, len(ends))
    return feats, which, sentence, at, ends, off


def telling(feats: np.ndarray, which: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which features are commoner in one class than chance has it. which, doc: of each word occurrence."""
    pair = np.unique(doc.astype(np.int64) * (len(feats) + 1) + which)
    doc, word = pair // (len(feats) + 1), pair % (len(feats) + 1)
    seen = np.zeros((2, DIM + 1))
    for j in range(feats.shape[1]):
        one = np.unique(doc * np.int64(DIM + 1) + feats[word, j])
        d, f = one // (DIM + 1), one % (DIM + 1)
        for c in (0, 1):
            seen[c] += np.bincount(f[y[d] == c], minlength=DIM + 1)
    n = np.array([(y == 0).sum(), (y == 1).sum()], dtype=np.float64)[:, None]
    seen = np.minimum(seen, n)
    ratio = np.zeros(DIM + 1)
    for part in (seen, n - seen):
        expected = part.sum(axis=0) * n / n.sum()
        ratio += 2 * np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9)), 0).sum(axis=0)
    ratio[DIM] = 0
    return ratio >= LEAST_RATIO


def _read_all(texts: Sequence[str], h: Hasher):
    """As _read, without the bytes; piece by piece, so that the hashes' sums stay small."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    out, words_before, ends_before = [], 0, 0
    for piece in slices(iter([batch])):
        feats, which, sentence, at, ends, _ = _read(piece.column("text"), h)
        out.append((feats.astype(np.int32), (which + words_before).astype(np.int32), (sentence + ends_before).astype(np.int32), at[:-1] + ends_before))
        words_before += len(feats)
        ends_before += len(ends)
    feats, which, sentence, at = (np.concatenate(x) for x in zip(*out))
    return feats, which, sentence, np.append(at, ends_before), ends_before


def slopes(z: np.ndarray, bag: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of the documents' log-likelihood (each counts `count`), by each sentence's z. bag: each sentence's document.

    A document is toxic with probability 1 - product of (1 - p), p = 1 / (1 + exp(-z)), so a toxic document's pull goes to its sentences by their p."""
    none = -np.bincount(bag, weights=np.logaddexp(0, z), minlength=len(y))  # log of "no sentence is toxic"
    pull = count * np.where(y > 0, np.exp(none) / np.maximum(-np.expm1(none), 1e-12), -1.0)
    return pull[bag] * np.exp(-np.logaddexp(0, -z))


class Model:
    def __init__(self):
        self.weights = np.zeros(DIM + 1, dtype=np.float32)
        self.bias = -5.0

    def sentences(self, feats: np.ndarray, which: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        v = self.weights[feats].sum(axis=1)
        return self.bias + np.bincount(sentence, weights=v[which], minlength=n)

    def train(self, texts: Sequence[str], labels: Sequence[int], weight_0: float, rounds: int = 150, rate: float = 0.2, decay: float = 1e-6) -> None:
        """weight_0: how much a document of class 0 counts."""
        feats, which, sentence, at, n = _read_all(texts, Hasher(SEED))
        y = np.asarray(labels, dtype=np.float64)
        count = np.where(y > 0, 1.0, weight_0)
        count /= count.sum()
        bag = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))
        feats = np.where(telling(feats, which, bag[sentence], y)[feats], feats, DIM)
        q, q_b = np.zeros(DIM + 1), 0.0
        for _ in range(rounds):
            z = self.sentences(feats, which, sentence, n)
            dz = slopes(z, bag, y, count)
            of_word = np.bincount(which, weights=dz[sentence], minlength=len(feats))
            g = np.bincount(feats.ravel(), weights=np.repeat(of_word, feats.shape[1]), minlength=DIM + 1) - decay * self.weights
            g[DIM] = 0
            q += g * g
            self.weights += (rate * g / np.sqrt(q + 1e-14)).astype(np.float32)
            g_b = dz.sum()
            q_b += g_b * g_b
            self.bias += rate * g_b / np.sqrt(q_b + 1e-14)


def _score(model: Model, carry: list[str]):
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(SEED)
        for piece in slices(batches):
            feats, which, sentence, at, ends, off = _read(piece.column("text"), h)
            n = len(ends)
            z = model.sentences(feats, which, sentence, n)
            bag = np.repeat(np.arange(piece.num_rows), np.diff(at))
            none = -np.bincount(bag, weights=np.logaddexp(0, z), minlength=piece.num_rows)
            score = -np.expm1(none)
            worst = np.flatnonzero(z >= 0)
            starts = np.r_[0, ends[:-1]][worst] if n else np.zeros(0, dtype=np.int64)
            base = off[bag[worst]]
            found = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends[worst] - base), pa.array(np.exp(-np.logaddexp(0, -z[worst])))], fields=list(kind))
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(bag[worst], np.arange(piece.num_rows + 1)), pa.int32()), found)
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in carry], pa.array(np.clip(score, 0, 1)), spans], names=[*carry, "score", "offending"])

    return run


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_class: tuple[int, int] = PER_CLASS) -> Model:
    """A model from a sample of the labelled documents: of each class those with the lowest hashes of their ids, at
    most per_class (toxic, not toxic), and of rows of one id two distinct texts at most, none over SAMPLE_BYTES long, and of a class no more than CLASS_BYTES. Without documents of both classes, no sentence is toxic."""
    known = labels.filter(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    model = Model()
    if not n.get(0) or not n.get(1):
        return model
    draw = F.xxhash64(F.lit(SEED), "doc_id")
    ids = known.filter("toxic = 1").orderBy(draw, "doc_id").limit(per_class[0]).unionByName(known.filter("toxic = 0").orderBy(draw, "doc_id").limit(per_class[1]))
    found = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).select("doc_id", "text").join(F.broadcast(ids), "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id", "toxic").orderBy(F.xxhash64("text"), "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    held = F.sum(size).over(Window.partitionBy("toxic").orderBy(draw, "doc_id", "__n").rowsBetween(Window.unboundedPreceding, -1))  # of a bounded number of rows
    rows = found.withColumn("__n", place).filter("__n <= 2").withColumn("__b", F.coalesce(held, F.lit(0)) + size)
    rows = rows.filter(F.col("__b") <= F.when(F.col("toxic") == 1, CLASS_BYTES[0]).otherwise(CLASS_BYTES[1])).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))
    if {r["toxic"] for r in rows} != {0, 1}:
        return model
    taken = [min(n[0], per_class[1]), min(n[1], per_class[0])]
    model.train([r["text"] or "" for r in rows], [r["toxic"] for r in rows], (n[0] / n[1]) / (taken[0] / taken[1]))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, usable: Column, per_class: tuple[int, int] = PER_CLASS) -> DataFrame:
    """doc_id, score and offending (byte ranges and scores of sentences at 0.5 or more) of every row.

    Null and empty texts have no sentence and score 0. A repeated row is scored like the first. A label counts for
    every row of its doc_id; null labels and ids don't count. The model is of fixed size. No shuffle of texts.
    """
    small_batches(docs.sparkSession)
    model = learn(docs, labels, usable, per_class)
    return docs.select("doc_id", "text").mapInArrow(_score(model, ["doc_id"]), "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def toxicity_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every row of documents; null and empty texts score 0. A null doc_id is not held out."""
    out = score_documents(docs, labels, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
