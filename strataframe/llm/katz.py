"""Language-model scores by Katz backoff, with count tables dealt over the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import LOWER_TABLE, Workspace, columns, fold_of, leanly, mix, pack, ragged, runs_of_texts, shuffle_parts, unpack

#: Counts up to this are discounted.
CUTOFF = 5
#: Characters of one encoded block, and n-grams that one bucket is to hold.
BLOCK = 8_000_000
BUCKET = 2_000_000
#: Contexts with more than this share of a bucket are dealt by word, too, and of all tokens one in so many at the least.
HOT, HOT_TOKENS = 4, 100_000
_ROLL = np.uint64(0x100000001B3)


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes of like weight together, so that what is small or alike compresses."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).ravel()


def unplaned(x: np.ndarray, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and each element's number among them, where a few values stand for many elements; else the elements alone."""
    values, at = np.unique(x, return_inverse=True)
    if 2 * len(values) > len(x):
        return planes(x), np.zeros(0, np.uint8)
    return values, planes(at.astype(np.uint16 if len(values) <= 1 << 16 else np.uint32))


def uncoded(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return unplaned(values, np.float64) if values.dtype == np.uint8 else values
    return values[unplaned(at, np.uint16 if len(values) <= 1 << 16 else np.uint32)]


def good_turing(counts_of: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """Factors for counts 0 to ``cutoff`` + 1 (beyond: 1) from the numbers of n-grams with each count.

    Where those numbers give no factor between 0 and 1 (too little text, or gaps among the
    counts), half a count is taken off instead.
    """
    d = np.ones(cutoff + 2)
    n = counts_of.astype(float)
    common = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    for r in range(1, cutoff + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        x = (star - common) / (1 - common) if common < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def word_bytes(sizes: np.ndarray, joined: np.ndarray) -> list[bytes]:
    data, ends = joined.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
    return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def encode(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """(block, payload): documents as indices into the block's distinct words, frequent ones first.

    Each text ends with an end token, the empty word.
    """

    @leanly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in runs_of_texts(rows, BLOCK):
                split = [[*t.encode().translate(LOWER_TABLE).split(), b""] for t in rows[lo:hi]]
                words = list(set().union(*split))
                index = dict(zip(words, range(len(words)), strict=True))
                size = np.fromiter(map(len, split), np.int64, len(split))
                at = np.fromiter((index[w] for t in split for w in t), np.int64, int(size.sum()))
                order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
                place = np.empty(len(words), np.uint32)
                place[order] = np.arange(len(words))
                words = [words[i] for i in order.tolist()]
                own = np.array([i or 0 for i in ids[lo:hi]], np.int64)
                null = np.array([i is None for i in ids[lo:hi]])
                held = np.array([i is not None and fold_of(i, folds) == held_out for i in ids[lo:hi]])
                load = pack(own, null, held, size.astype(np.uint32), planes(place[at]), planes(np.array([len(w) for w in words], np.uint32)), np.frombuffer(b"".join(words), np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([load], pa.binary())], ["block", "payload"])
                number += 1

    return docs.mapInArrow(run, "block long, payload binary")


class Level(NamedTuple):
    """What blocks need of an order besides their answers: its discount factors, and the statistics of hot contexts."""

    discount: np.ndarray
    hot: np.ndarray
    stats: np.ndarray


class Words:
    """The order-1 model: discounted counts, and all that is left for any unseen word."""

    def __init__(self, stats: np.ndarray):
        self.counts_of, self.tokens, self.types = stats[: CUTOFF + 2], int(stats[-2]), int(stats[-1])
        self.discount = good_turing(self.counts_of)
        n = np.arange(CUTOFF + 2)
        lost = float((self.counts_of[: CUTOFF + 1] * n[: CUTOFF + 1] * (1 - self.discount[: CUTOFF + 1])).sum())
        self.unseen = lost / self.tokens if self.tokens else 1.0
        if not self.unseen:  # no rare word: half a count
            self.unseen = 0.5 / (self.tokens + 0.5)
        self.rest = 1 - self.unseen if not lost else 1.0
        #: Contexts with larger counts are hot.
        self.hot = max(BUCKET // HOT, self.tokens // HOT_TOKENS)

    def probabilities(self, count: np.ndarray) -> np.ndarray:
        p = self.rest * self.discount[np.minimum(count, CUTOFF + 1)] * count / max(1, self.tokens)
        return np.where(count > 0, p, self.unseen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def context_stats(fresh: np.ndarray, count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each context (its n-grams stand together): how many n-grams have each count up to the
    cutoff, the sum of the other counts, and what the order below gives to the words seen."""
    known = count > 0
    parts = [known & (count == r) for r in range(1, CUTOFF + 1)] + [np.where(count > CUTOFF, count, 0), np.where(known, below, 0.0)]
    return np.stack([np.add.reduceat(x.astype(np.float64), fresh) for x in parts], 1) if len(fresh) else np.zeros((0, CUTOFF + 2))


def backoff(stats: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each context's count, the factor on its words' discounted shares, and its backoff weight.

    Weights are exactly normalised: what discounting takes, over what the order below gives to
    words not seen in the context, which always holds the unseen word. A context without rare
    words gives half a count away; an unseen context has weight 1.
    """
    r = np.arange(1, CUTOFF + 1)
    total = stats[:, :CUTOFF] @ r + stats[:, CUTOFF]
    taken = stats[:, :CUTOFF] @ (r * (1 - discount[1 : CUTOFF + 1]))
    none = taken <= 0
    left = np.where(none, 0.5 / (total + 0.5), taken / np.maximum(total, 1))
    weight = np.where(total > 0, left / (1 - stats[:, CUTOFF + 1]), 1.0)
    return total, np.where(none, 1 - left, 1.0), weight


class Block:
    """A block of documents at the order that its answers have reached."""

    def __init__(self, data: bytes, told: pa.Table | None, buckets: int, word: Words | None = None, levels: list[Level] = ()):
        import xxhash

        self.ids, self.null, self.held_out, size, at, sizes, joined = unpack(data)
        self.size, self.buckets, self.word = size.astype(np.int64), buckets, word
        self.at = unplaned(at, np.uint32).astype(np.int64)
        self.sizes, self.joined = unplaned(sizes, np.uint32), joined
        bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in word_bytes(self.sizes, joined)], np.int64)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.by_bucket], np.arange(buckets + 1))
        self.owner = np.repeat(np.arange(len(self.ids)), self.size)
        self.training = ~self.held_out[self.owner]
        if told is None:
            return
        answers: dict[int, list[tuple[int, bytes]]] = {}
        for n, b, x in zip(*(told.column(c).to_pylist() for c in ("order", "bucket", "payload")), strict=True):
            answers.setdefault(n, []).append((b, x))
        self.gid, self.count = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        for b, x in answers.get(1, []):
            rank, count = unpack(x)
            some = self.by_bucket[self.cuts[b] : self.cuts[b + 1]]
            self.gid[some], self.count[some] = unplaned(rank, np.uint32).astype(np.int64) * buckets + b + 1, unplaned(count, np.int64)
        self.words, self.word_count, self.which = self.gid, self.count, self.at
        self.prob = word.probabilities(self.count)[self.at]
        for n, level in enumerate(levels, 2):
            self.extend()
            self.hear(answers.get(n, []), level)

    def extend(self) -> None:
        """To the distinct n-grams of the next order: (context, word) as global numbers, exact without hashes."""
        before = np.r_[0, self.which[:-1] + 1] if len(self.at) else self.which
        before[np.cumsum(self.size) - self.size] = 0
        wide = len(self.sizes)
        code, self.seen, which = np.unique(before * wide + self.at, return_index=True, return_inverse=True)
        context, last = code // wide, code % wide
        self.context, self.last = np.r_[0, self.gid][context], self.words[last]
        self.hot = np.r_[np.iinfo(np.int64).max, self.count][context] > self.word.hot
        key = mix(self.context.astype(np.uint64))
        key = np.where(self.hot, mix(key * _ROLL ^ self.last.astype(np.uint64)), key)
        bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        small = len(code) and int(self.context.max()) < 1 << 40 and self.buckets < 1 << 22
        self.order = np.argsort(bucket << 40 | self.context, kind="stable") if small else np.lexsort((self.context, bucket))
        self.gram_cuts = np.searchsorted(bucket[self.order], np.arange(self.buckets + 1))
        self.which, self.below = which, self.prob

    def ask(self) -> Iterator[tuple[int, bytes]]:
        count = np.bincount(self.which[self.training], minlength=len(self.seen))
        below = self.below[self.seen]
        for b in range(self.buckets):
            at = self.order[self.gram_cuts[b] : self.gram_cuts[b + 1]]
            if len(at):
                yield b, pack(planes(np.diff(self.context[at], prepend=0)), planes(self.last[at]), planes(count[at].astype(np.uint32)), *coded(below[at]), np.packbits(self.hot[at]))

    def hear(self, answers: list[tuple[int, bytes]], level: Level) -> None:
        """Takes the buckets' answers: each n-gram's count and number, and its context's statistics."""
        n = len(self.seen)
        count, gid, stats = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, CUTOFF + 2))
        for b, data in answers:
            at = self.order[self.gram_cuts[b] : self.gram_cuts[b + 1]]
            c, rank, small, large, values, free = unpack(data)
            count[at] = unplaned(c, np.uint32)
            if len(rank):
                gid[at] = unplaned(rank, np.uint32).astype(np.int64) * self.buckets + b + 1
            fresh = np.r_[True, self.context[at][1:] != self.context[at][:-1]]
            own = np.concatenate([unplaned(small, np.uint32).reshape(CUTOFF, -1), unplaned(large, np.int64)[None], uncoded(values, free)[None]]).T
            stats[at] = own[np.cumsum(fresh) - 1]
        if self.hot.any():
            k = np.minimum(np.searchsorted(level.hot, self.context), max(0, len(level.hot) - 1))
            found = self.hot & (level.hot[k] == self.context) if len(level.hot) else np.zeros(n, bool)
            stats[self.hot] = 0
            stats[found] = level.stats[k[found]]
        total, factor, weight = backoff(stats, level.discount)
        p = factor * level.discount[np.minimum(count, CUTOFF + 1)] * count / np.maximum(total, 1)
        self.count, self.gid = count, gid
        self.prob = np.where(count[self.which] > 0, p[self.which], weight[self.which] * self.below)


def word_table(encoded: DataFrame, buckets: int) -> DataFrame:
    """(order, bucket, block, payload): numbers and training counts of a block's words; block -1: counts of counts, tokens and types."""

    @leanly
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                e = Block(data, None, buckets)
                count = np.bincount(e.at[e.training], minlength=len(e.sizes)).astype(np.uint32)
                first = np.cumsum(e.sizes, dtype=np.int64) - e.sizes
                for b in np.flatnonzero(np.diff(e.cuts)).tolist():
                    at = e.by_bucket[e.cuts[b] : e.cuts[b + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block], pa.int64()), pa.array([pack(e.sizes[at], e.joined[ragged(first[at], e.sizes[at].astype(np.int64))], count[at])], pa.binary())], ["bucket", "block", "payload"])

    @leanly
    def answer(batch: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        which, counts = [], []
        for data in batch.column("payload").to_pylist():
            sizes, joined, count = unpack(data)
            which.append(np.array([number.setdefault(w, len(number)) for w in word_bytes(sizes, joined)], np.int64))
            counts.append(count)
        total = np.bincount(np.concatenate(which), np.concatenate(counts), minlength=len(number)).astype(np.int64)
        rank = np.empty(len(total), np.uint32)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))  # frequent words have small numbers
        known = total[total > 0]
        stats = np.r_[np.bincount(np.minimum(known, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2], known.sum(), len(known)]
        loads = [pack(planes(rank[w]), planes(total[w])) for w in which]
        return answered(1, batch, loads, stats)

    return encoded.mapInArrow(ask, "bucket int, block long, payload binary").groupBy("bucket").applyInArrow(answer, ANSWERS)


ANSWERS = "order int, bucket int, block long, payload binary"


def answered(order: int, batch: pa.Table, loads: list[bytes], stats: np.ndarray) -> pa.Table:
    b, n = batch.column("bucket")[0].as_py(), len(loads) + 1
    return pa.table({"order": pa.array([order] * n, pa.int32()), "bucket": pa.array([b] * n, pa.int32()), "block": pa.array([*batch.column("block").to_pylist(), -1], pa.int64()), "payload": pa.array([*loads, pack(stats)], pa.binary())})


def gram_table(encoded: DataFrame, told: DataFrame, order: int, last: bool, word: Words, levels: list[Level], buckets: int) -> DataFrame:
    """Answers of an order: the counts of a block's n-grams and their contexts' statistics.

    Block -1 has the counts of counts, block -2 a bucket's share of hot contexts' statistics. A
    block sends each distinct n-gram once, with its count in training and the probability that
    the order below gives its last word. All n-grams of a context go to one bucket, but those of
    hot contexts, which are dealt by word.
    """

    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        e = Block(block.column("payload")[0].as_py(), answers, buckets, word, levels)
        e.extend()
        out = list(e.ask())
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([block.column("block")[0].as_py()] * len(out), pa.int64()), "payload": pa.array([x[1] for x in out], pa.binary())})

    def merge(batch: pa.Table) -> pa.Table:
        parts = []
        for data in batch.column("payload").to_pylist():
            context, w, count, values, below, hot = unpack(data)
            n = len(context) // 8
            parts.append((np.cumsum(unplaned(context, np.int64)), unplaned(w, np.int64), unplaned(count, np.uint32), uncoded(values, below), np.unpackbits(hot, count=n).view(bool)))
        context, w, count, below, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        del parts
        new = np.lexsort((w, context))
        c, x = context[new], w[new]
        fresh = np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1])]
        heads = np.flatnonzero(fresh)
        gram = np.empty(len(new), np.int64)
        gram[new] = np.cumsum(fresh) - 1
        total = np.add.reduceat(count[new].astype(np.int64), heads)
        starts = np.flatnonzero(np.r_[True, c[heads][1:] != c[heads][:-1]])
        stats = context_stats(starts, total, below[new[heads]])
        whose = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(heads)]))
        rank = np.empty(len(total), np.uint32)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        loads = []
        for some, own in zip(np.split(gram, ends), np.split(context, ends), strict=True):
            mine = stats[whose[some[np.flatnonzero(np.r_[True, own[1:] != own[:-1]])]]]
            loads.append(pack(planes(total[some].astype(np.uint32)), planes(rank[some]) if not last else np.zeros(0, np.uint8), planes(np.ascontiguousarray(mine[:, :CUTOFF].T).astype(np.uint32).ravel()), planes(mine[:, CUTOFF].astype(np.int64)), *coded(mine[:, CUTOFF + 1])))
        known = total[total > 0]
        out = answered(order, batch, loads, np.bincount(np.minimum(known, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2])
        warm = np.flatnonzero(hot[new[heads[starts]]])
        if len(warm):
            share = pack(c[heads[starts[warm]]], stats[warm].ravel())
            out = pa.concat_tables([out, pa.table({"order": pa.array([order], pa.int32()), "bucket": batch.column("bucket")[:1], "block": pa.array([-2], pa.int64()), "payload": pa.array([share], pa.binary())})])
        return out

    sent = encoded.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(leanly(ask), "bucket int, block long, payload binary")
    return sent.groupBy("bucket").applyInArrow(leanly(merge), ANSWERS)


def added(rows: DataFrame, n: int) -> np.ndarray:
    """The sum of all payloads of ``n`` numbers, added up in tasks first."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += unpack(x)[0]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total)], ["k", "n"])

    out = np.zeros(n, np.int64)
    for r in rows.select("payload").mapInArrow(some, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


def hot_contexts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of hot contexts, of which there are at most HOT_TOKENS an order, added up over buckets."""
    names = [f"s{k}" for k in range(CUTOFF + 2)]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                context, stats = unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(context), b, np.int32)), pa.array(context), *(pa.array(np.ascontiguousarray(y)) for y in stats.reshape(-1, CUTOFF + 2).T)], ["bucket", "context", *names])

    each = rows.select("bucket", "payload").mapInArrow(some, "bucket int, context long, " + ", ".join(f"{n} double" for n in names))
    got = sorted(each.groupBy("context").agg(*(F.sum(n).alias(n) for n in names)).collect())
    return np.array([r.context for r in got], np.int64), np.array([[r[n] for n in names] for r in got]).reshape(-1, CUTOFF + 2)


def katz_scores(docs: DataFrame, order: int = 2, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Texts of the held-out fold are scored but not counted. Words are lower-cased (A-Z) and each
    text ends with an end token; a null or empty text is that token alone. A null id is in
    training. Repeated rows count as often as they stand. Words unknown in training are one
    class, which has what discounting leaves; so every order's probabilities sum to one over the
    known words and that class. Words are compared whole and numbered; an n-gram is its context's
    number and its word's, so nothing rests on hashes. An empty table gives an empty result; a
    very long text is a block of its own.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "katz")
    rows = columns(docs, id_col, text=text_col)
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(shuffle_parts(spark), int(chars) // 6 // BUCKET + 1)
    encoded = work.write(encode(rows, folds, held_out), "encoded", "uncompressed")
    words = work.write(word_table(encoded, buckets), "words", "uncompressed")
    word = Words(added(words.where("block = -1"), CUTOFF + 4))
    told, levels = words.where("block >= 0"), []
    for n in range(2, order + 1):
        grams = work.write(gram_table(encoded, told, n, n == order, word, list(levels), buckets), f"grams{n}", "uncompressed")
        levels.append(Level(good_turing(added(grams.where("block = -1"), CUTOFF + 2)), *hot_contexts(grams.where("block = -2"))))
        told = told.unionByName(grams.where("block >= 0"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    @leanly
    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        e = Block(block.column("payload")[0].as_py(), answers, buckets, word, levels)
        count = e.word_count[e.at]
        add = lambda x: np.bincount(e.owner, x, minlength=len(e.ids))
        made = [pa.array(e.ids, mask=e.null), pa.array(e.held_out), pa.array(e.size), pa.array(add(count > 0).astype(np.int64)), pa.array(np.full(len(e.ids), word.tokens)), pa.array(add(word.base(count))), pa.array(add(np.log10(e.prob)))]
        return pa.Table.from_arrays(made, schema=schema)

    return encoded.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
