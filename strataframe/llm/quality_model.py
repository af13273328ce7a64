"""A quality classifier of hashed word and character n-gram vectors, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import columns, fold, runs_of_texts

#: Buckets of the hashed vectors; the first is for a word that follows itself.
BITS = 17
NGRAMS = (3, 4, 5)
#: Words remembered by a worker; beyond that it starts anew.
MEMO = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0x100000001B3)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    x = (h ^ np.uint64(kind * 0x51ED270B)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return np.maximum((x >> np.uint64(64 - BITS)).astype(np.int64), 1)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, and its buckets: one of the whole word and one of each n-gram of <word>.

    The buckets come flat, with the number of them that each word has. N-grams are of UTF-8 bytes.
    """
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    rolled = flat + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(flat))  # bytes up to the word's end
    power = np.cumprod(np.full(len(flat) if len(flat) < 1 << 16 else 1 << 16, _ROLL))
    within = np.arange(len(flat)) - np.repeat(start, size)
    whole = np.add.reduceat(rolled * power[within % len(power)] * (np.uint64(1) + (within // len(power)).astype(np.uint64)), start) if len(words) else np.zeros(0, np.uint64)
    buckets, owners = [_bucket(whole, 1)], [np.arange(len(words))]
    gram = rolled
    for n in range(2, max(NGRAMS) + 1):
        gram = gram[:-1] * _ROLL + rolled[n - 1 :] if len(gram) > 1 else gram[:0]
        if n in NGRAMS:
            ok = left[: len(gram)] >= n
            buckets.append(_bucket(gram[ok], n))
            owners.append(owner[: len(gram)][ok])
    flat_owner = np.concatenate(owners)
    order = np.argsort(flat_owner, kind="stable")
    return whole, np.concatenate(buckets)[order], np.bincount(flat_owner, minlength=len(words))


def pair_buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; a word that follows itself has the bucket of all such pairs."""
    return np.where(h[1:] == h[:-1], 0, _bucket(h[:-1] * _ROLL ^ h[1:], 9))


class Model(NamedTuple):
    """The two-class model as the log-odds that each bucket adds; averages of vectors are linear in them."""

    odds: np.ndarray
    bias: float


def document_bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights: half for words and their n-grams, half for pairs."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    h, buckets, n = word_features(list(distinct))
    each = np.bincount(at, minlength=len(distinct)) / len(words) / n
    where, weight = [buckets], [np.repeat(each, n) / 2]
    if len(words) > 1:
        pairs = pair_buckets(h[at])
        where.append(pairs)
        weight.append(np.full(len(pairs), 0.5 / len(pairs)))
    found, back = np.unique(np.concatenate(where), return_inverse=True)
    return found, np.bincount(back, np.concatenate(weight))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 5, steps: int = 600, rate: float = 40.0, batch: int = 32, seed: int = 7) -> Model:
    """Softmax regression on averaged vectors, the vectors learned with it, by mini-batch SGD.

    It runs ``epochs`` times over the bags, or as often as it takes to make ``steps`` updates.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    if not len(labels) or labels.min() == labels.max():  # one class or none: its share, smoothed
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    per_epoch = -(-len(bags) // batch)
    epochs = max(epochs, -(-steps // per_epoch))
    steps, done = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            lr = rate * (1 - done / steps)
            done += 1
            sizes = np.array([len(bags[i][0]) for i in some])
            idx, val = (np.concatenate([bags[i][k] for i in some]).astype(kind) for k, kind in enumerate((np.int64, np.float64)))
            row = np.repeat(np.arange(len(some)), sizes)
            used, slot = np.unique(idx, return_inverse=True)
            held = vectors[used]
            mean = np.stack([np.bincount(row, val * held[slot, k], minlength=len(some)) for k in range(dim)], 1)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p /= len(some)
            back = p @ out.T
            for k in range(dim):
                held[:, k] -= lr * np.bincount(slot, val * back[row, k], minlength=len(used))
            vectors[used] = held
            out -= lr / 10 * (mean.T @ p)
            bias -= lr / 40 * p.sum(0)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.hash, self.odds = np.zeros(0, np.uint64), np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        split = [t.encode().split() for t in texts]
        wanted = set().union(*split)
        new = list(wanted - self.memo.keys())
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.hash, self.odds = {}, np.zeros(0, np.uint64), np.zeros(0)
            new = list(wanted)
        if new:
            h, buckets, n = word_features(new)
            odds = np.add.reduceat(self.model.odds[buckets].astype(np.float64), np.cumsum(n) - n) / n
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            self.hash, self.odds = np.concatenate([self.hash, h]), np.concatenate([self.odds, odds])
        z = np.full(len(texts), self.model.bias)
        get = self.memo.__getitem__
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(get, words), np.int64, len(words))
                z[i] += self.odds[at].mean() / 2
                if len(words) > 1:
                    z[i] += self.model.odds[pair_buckets(self.hash[at])].astype(np.float64).mean() / 2
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most_docs: int = 3000, most_chars: int = 30_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of labelled documents whose fold isn't the held-out one.

    At most ``most_docs`` labelled documents of at most ``most_chars`` characters together are
    used, those whose ids have the smallest hashes: the driver holds what is gathered, whatever
    the table's size. Null labels and labels of absent documents are left out.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.col(id_col), F.lit(1))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    picked = known.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"), order.alias("at")).orderBy("at", "doc_id", "label").limit(most_docs).collect()
    if not picked:
        return train([], np.zeros(0, np.int64))
    ids = F.broadcast(spark.createDataFrame([tuple(r) for r in picked], "doc_id long, label int, at long"))
    rows = columns(docs, id_col, text=text_col).withColumnRenamed(id_col, "doc_id").join(ids, "doc_id")
    used = 0
    last = None
    for r in sorted(rows.select("at", F.length("text").alias("n")).collect()):
        used += r.n
        if last is not None and used > most_chars:
            break
        last = r.at

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [document_bag(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([b.astype(np.float32).tobytes() for _, b in made], pa.binary())],
                ["at", "doc_id", "label", "buckets", "weights"],
            )

    some = rows.where(F.col("at") <= F.lit(last)).select("at", "doc_id", "label", "text") if last is not None else rows.select("at", "doc_id", "label", "text")
    got = sorted(some.mapInArrow(bags, "at long, doc_id long, label int, buckets binary, weights binary").collect())
    return train([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.weights, np.float32)) for r in got], np.array([r.label for r in got], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row per input row: doc_id and score, from the whole text alone; or the columns ``carry`` and score.

    Null and empty texts have the model's bias as their score; repeated rows have equal scores.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *(carry or [F.col(id_col).cast("long").alias("doc_id")]))
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            parts = [scorer.scores(texts[lo:hi]) for lo, hi in runs_of_texts(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate([np.zeros(0), *parts]))], [*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{kinds}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of fold ``held_out`` are never read."""
    model = fit(docs, labels, folds, held_out, **bounds)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
