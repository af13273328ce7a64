"""Packing documents into sequences by the configuration program of their lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import WordRows, Workspace, columns, leanly, ragged, runs_of_texts
from strataframe.llm.token_counts import RankMerger

#: Words that a worker remembers with their ids.
MEMO = 400_000
#: Lengths up to which the configuration program is solved to a gap; beyond it is solved in a few phases.
LENGTHS = 256
#: The pre-tokens of this kind of vocabulary, in lower case, and the words that are split by it here.
TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
STABLE = re.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u0188]*").fullmatch
#: Of these, lines of words without apostrophes and the two signs among the letters.
PLAIN = re.compile("[\n\x21-\x26\x28-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u0188]*").fullmatch


class Pattern(NamedTuple):
    """A filling of one sequence, its lengths in falling order, and how many sequences have it."""

    lengths: tuple[int, ...]
    copies: int


class Plan(NamedTuple):
    """Patterns that hold every item exactly once, and a number of sequences that no packing can go below."""

    patterns: list[Pattern]
    bound: int


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity the best price, and the item (0: none) that comes last in it.

    ``price`` is by length, from 0 on, negative where there is no such length. Every length may
    be used as often as it fits. Of equal prices the longest item is taken.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    own = price[capacity:0:-1].copy()  # longest first
    for room in range(1, capacity + 1):
        total = best[:room] + own[capacity - room :]
        k = int(total.argmax())
        if total[k] > best[room - 1]:
            best[room], last[room] = total[k], room - k
        else:
            best[room] = best[room - 1]
    return best, last


def fractional(demand: np.ndarray, capacity: int, phases: int = 24, eager: float = 4.0, step: float = 0.5, slack: float = 0.02) -> tuple[dict[tuple[int, ...], float], float]:
    """Columns of the configuration program with the share that each is used, and a bound from its dual.

    The program has a column for each filling of a sequence and a row for each length. Weights are
    multiplicative: a length's price is its share of the capacity times exp(-eager * its covered
    share). A phase prices all lengths at once by one knapsack; every length gives the best column
    that holds it, in which no length is used more often than it is wanted, and columns within
    ``slack`` of the best are used by ``step`` of what their scarcest length wants, unless one of
    their lengths has got its step in this phase. It ends when every length is covered. By duality
    the prices, divided by the best column's, bound the number of sequences from below.
    """
    lengths = np.flatnonzero(demand)
    size = np.arange(capacity + 1) / capacity
    wanted, covered = demand.tolist(), np.zeros(capacity + 1)
    out: dict[tuple[int, ...], float] = {}
    bound = 0.0
    for _ in range(phases):
        open_ = lengths[covered[lengths] < 1]
        if not len(open_):
            break
        price = np.full(capacity + 1, -1.0)
        price[lengths] = size[lengths] * np.exp(-eager * covered[lengths])
        best, last = knapsack(price, capacity)
        bound = max(bound, float((demand[lengths] * price[lengths]).sum()) / best[capacity])
        worth = price[open_] + best[capacity - open_]
        order = np.argsort(covered[open_] - 1e-6 * open_, kind="stable")
        # The largest room up to each in which an item comes last.
        filled = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0)).tolist()
        last, got = last.tolist(), [0.0] * (capacity + 1)
        for n in open_[order][(worth >= (1 - slack) * best[capacity])[order]].tolist():
            if got[n] >= step:
                continue
            used, room, refused = {n: 1}, filled[capacity - n], 0
            while room and refused < 64:
                k = last[room]
                if used.get(k, 0) < wanted[k] and got[k] < 2 * step:
                    used[k] = used.get(k, 0) + 1
                    room = filled[room - k]
                else:
                    refused += 1
                    room = filled[room - 1]
            if sum(price[k] * times for k, times in used.items()) < (1 - slack) * best[capacity]:
                continue
            share = step * min(wanted[k] / times for k, times in used.items())
            column = tuple(k for k in sorted(used, reverse=True) for _ in range(used[k]))
            out[column] = out.get(column, 0.0) + share
            for k, times in used.items():
                got[k] += share * times / wanted[k]
        covered += got
    return out, bound


def solved(demand: np.ndarray, capacity: int, gap: float = 0.001, rounds: int = 40, steps: int = 400) -> tuple[dict[tuple[int, ...], float], float, float]:
    """Columns of the configuration program with their shares, their sum, and the bound that the dual gives.

    The program as a game: columns against lengths, a column's gain with a length being the share of
    it that it covers. Both sides' weights are multiplicative and each looks one step ahead at
    the other's last change; the averages of a round are its answer. One knapsack a round prices
    all columns by the lengths' weights, adds to the pool the best column that holds each length,
    and bounds the program from below. It ends when the shares' sum is within ``gap`` of the bound.
    A round costs the pool times the lengths, so this is for histograms of LENGTHS lengths at most.
    """
    lengths = np.flatnonzero(demand)
    wanted, row = demand[lengths].astype(float), {int(n): k for k, n in enumerate(lengths)}
    pool: dict[tuple[int, ...], int] = {}
    gain = np.zeros((0, len(lengths)))
    w = wanted * lengths
    w /= w.sum()
    z, best_z, total, bound = np.zeros(0), np.zeros(0), np.inf, 0.0
    for _ in range(rounds):
        price = np.full(capacity + 1, -1.0)
        price[lengths] = w / wanted
        best, last = knapsack(price, capacity)
        bound = max(bound, 1 / best[capacity])
        if total <= bound * (1 + gap):
            break
        filled = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0))
        made = []
        for n in lengths.tolist():
            column, room = [n], int(filled[capacity - n])
            while room:
                column.append(int(last[room]))
                room = int(filled[room - column[-1]])
            key = tuple(sorted(column, reverse=True))
            if key not in pool:
                pool[key] = len(pool)
                made.append(np.bincount([row[k] for k in key], minlength=len(lengths)) / wanted)
        gain = np.vstack([gain, *made])
        z = np.r_[z * 0.7, np.full(len(made), (0.3 if len(z) else 1.0) / max(1, len(made)))]
        z /= z.sum()
        # Steps by the widest gain of either side, relative to the value of the game.
        size = 0.5 * bound / np.sqrt(max((gain @ w).max(), (z @ gain).max()) * bound)
        log_z, log_w = np.log(z + 1e-12), np.log(w + 1e-15)
        before_z, before_w = gain @ w, z @ gain
        sum_z, sum_w = np.zeros(len(z)), np.zeros(len(w))
        for _ in range(steps):
            now_z, now_w = gain @ w, z @ gain
            log_z += size * (2 * now_z - before_z)
            log_w -= size * (2 * now_w - before_w)
            log_z -= log_z.max()
            log_w -= log_w.max()
            z, w = np.exp(log_z), np.exp(log_w)
            z /= z.sum()
            w /= w.sum()
            before_z, before_w = now_z, now_w
            sum_z += z
            sum_w += w
        average = sum_z / sum_z.sum()
        for some in (average, z):
            least = (some @ gain).min()
            if least > 0 and 1 / least < total:
                total, best_z = 1 / least, some / least
        z, w = average, sum_w / sum_w.sum()
    return {c: float(best_z[k]) for c, k in pool.items() if k < len(best_z) and best_z[k] > 1e-9}, float(total), float(bound)


def best_fit(left: np.ndarray, capacity: int, begun: dict[tuple[int, ...], int] | None = None) -> dict[tuple[int, ...], int]:
    """Best fit over a histogram: lengths in falling order, each into the fullest sequences that still take it, those ``begun`` included."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    for held, copies in (begun or {}).items():
        bins.setdefault(capacity - sum(held), {})[held] = copies
    for n in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[n])
        for room in sorted(r for r in bins if r >= n):
            if not todo:
                break
            each = room // n
            for held, copies in list(bins[room].items()):
                full = min(copies, todo // each)
                for count, times in ((full, each), (1 if full < copies and todo - full * each else 0, todo - full * each)):
                    if count and times:
                        bins[room][held] -= count
                        to = bins.setdefault(room - n * times, {})
                        key = tuple(sorted(held + (n,) * times, reverse=True))
                        to[key] = to.get(key, 0) + count
                        todo -= count * times
                if not bins[room][held]:
                    del bins[room][held]
                if not todo:
                    break
            if not bins[room]:
                del bins[room]
        each = capacity // n
        for count, times in ((todo // each, each), (1, todo % each)):
            if count and times:
                to = bins.setdefault(capacity - n * times, {})
                to[(n,) * times] = to.get((n,) * times, 0) + count
    out: dict[tuple[int, ...], int] = {}
    for held in bins.values():
        for key, copies in held.items():
            out[key] = out.get(key, 0) + copies
    return out


def plan(counts: dict[int, int], capacity: int, rounds: int = 2) -> Plan:
    """Patterns that hold every item of the length histogram exactly once, and a lower bound.

    A histogram of LENGTHS lengths at most has its program solved to within a thousandth of its
    bound. For every histogram the fractional program is also solved in a few phases.

    The fractional configuration program is solved by multiplicative weights and its columns are
    rounded down, to no more than their lengths still need, the most used ones first; what that
    leaves is a smaller program, solved again. Best fit over falling lengths packs the rest, into
    what room the columns have and new sequences. Columns are also rounded down to a half and a
    quarter of their share, which leaves more of the small items to the rest. The rounding with the
    fewest sequences is the plan, or best fit alone where that has fewer. The histogram has at most ``capacity`` rows, so neither time nor
    the plan's size grows with the number of documents.
    """
    demand = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        demand[n] = k
    demand[0] = 0
    bound = -(-int((demand * np.arange(capacity + 1)).sum()) // capacity)
    made: list[dict[tuple[int, ...], int]] = [best_fit(demand, capacity)]
    if 0 < len(np.flatnonzero(demand)) <= LENGTHS:
        columns, _, least = solved(demand, capacity)
        bound = max(bound, int(np.ceil(least - 1e-6)))
        for whole in (np.floor, np.round):
            out, left = {}, demand.copy()
            for column, share in sorted(columns.items(), key=lambda x: (-x[1], x[0])):
                used, times = np.unique(column, return_counts=True)
                if copies := min(int(whole(share)), int((left[used] // times).min())):
                    out[column] = copies
                    left[used] -= copies * times
            made.append(best_fit(left, capacity, out))
    first = fractional(demand, capacity)
    bound = max(bound, int(np.ceil(first[1] - 1e-6)))
    for part in (1.0, 0.5, 0.25):
        out: dict[tuple[int, ...], int] = {}
        left = demand.copy()
        for k in range(rounds):
            columns = fractional(left, capacity)[0] if k else first[0]
            took = 0
            for column, share in sorted(columns.items(), key=lambda x: (-x[1], x[0])):
                used, times = np.unique(column, return_counts=True)
                copies = min(int(share * part), int((left[used] // times).min()))
                if copies:
                    out[column] = out.get(column, 0) + copies
                    left[used] -= copies * times
                    took += copies
            if not took or part < 1:
                break
        made.append(best_fit(left, capacity, out))
        if sum(made[-1].values()) == bound:
            break
    best = min(made, key=lambda x: sum(x.values()))
    return Plan([Pattern(k, v) for k, v in sorted(best.items(), reverse=True)], bound)


class Slots:
    """Where the r-th item of each length goes."""

    def __init__(self, patterns: list[Pattern]):
        rows = []
        first = 0
        for p in patterns:
            offset = 0
            at: dict[int, list[int]] = {}
            for n in p.lengths:
                at.setdefault(n, []).append(offset)
                offset += n
            rows += [(n, len(o), p.copies, first, o) for n, o in at.items()]
            first += p.copies
        rows.sort(key=lambda r: r[0])
        self.sequences = first
        self.length = np.array([r[0] for r in rows], np.int64)
        self.each = np.array([r[1] for r in rows], np.int64)
        total = self.each * np.array([r[2] for r in rows], np.int64)
        self.first = np.array([r[3] for r in rows], np.int64)
        self.offsets = np.array([x for r in rows for x in r[4]], np.int64)
        self.at = np.cumsum(self.each) - self.each
        before = np.cumsum(total) - total
        fresh = np.r_[True, self.length[1:] != self.length[:-1]] if len(rows) else np.zeros(0, bool)
        self.base = before - np.repeat(before[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(rows)])) if len(rows) else before
        # Ranks of a length lie between its rows' bases; lengths are kept apart by a large step.
        self.step = int(total.sum()) + 1
        self.key = self.length * self.step + self.base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, length * self.step + rank, side="right") - 1
        within = rank - self.base[row]
        return self.first[row] + within // self.each[row], self.offsets[self.at[row] + within % self.each[row]]


def _classes() -> np.ndarray:
    """Of each byte in a stable word: 0 a line's end, 1 a letter's, 2 a digit, 3 a sign."""
    out = np.full(256, 3, np.uint8)
    out[ord("a") : ord("z") + 1] = out[128:] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[10] = 0
    return out


CLASS = _classes()


class WordIds:
    """Ids of texts, as the library gives them, each distinct word merged once.

    White space only separates in this kind of vocabulary, so a text's ids are those of its
    words between ASCII white space, one after another. Stable words have characters that every
    Unicode version lower-cases and classes alike, and that are their own composed form; without
    apostrophes their pre-tokens are runs of letters, single digits and runs of signs, and a
    batch's new words are split and merged together. Apostrophes are split by the pattern, and
    the library encodes all other words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.merger = RankMerger(path)
        self.words = WordRows(self._learn, MEMO)

    def _runs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of stable words without apostrophes, or of such words' pre-tokens."""
        text = np.frombuffer(b"\n".join(words).decode().lower().encode(), np.uint8)
        kind = CLASS[text]
        inside = kind > 0
        before = np.r_[np.uint8(0), kind[:-1]]
        fresh = inside & ((kind != before) | (kind == 2))
        word = np.cumsum(~inside)[fresh]
        at = np.flatnonzero(fresh[inside])
        flat, n = self.merger.merge(text[inside], np.diff(np.r_[at, int(inside.sum())]))
        return flat, np.bincount(word, n, minlength=len(words)).astype(np.int64)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = "\n".join([w.decode() for w in words])
        plain = bool(PLAIN(text)) and not any(s in text for s in self.special)
        odd = [] if plain else [i for i, w in enumerate(words) if not PLAIN(x := w.decode()) or any(s in x for s in self.special)]
        if not odd:
            return self._runs(words)
        other, size = [], np.zeros(len(words), np.int64)
        for i in odd:
            w = words[i].decode()
            if STABLE(w) and not any(s in w for s in self.special):
                tokens = [t.encode() for t in TOKENS(w.lower())]
                other.append(self.merger.merge(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens]))[0])
            else:
                other.append(np.array(self.library.encode(w, add_special_tokens=False).ids, np.int64))
            size[i] = len(other[-1])
        rest = np.ones(len(words), bool)
        rest[odd] = False
        flat, n = self._runs([w for w, ok in zip(words, rest, strict=True) if ok]) if rest.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        size[rest] = n
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[ragged(start[rest], n)] = flat
        out[ragged(start[odd], size[odd])] = np.concatenate(other)
        return out, size

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the number of each text's."""
        return self.words.ids([t.encode().split() for t in texts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        flat, n = self.ids(texts)
        data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_held: dict[str, WordIds] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of at most ``capacity`` ids; each document's ids end with ``end_id``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    @leanly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _held:
            _held[vocabulary] = WordIds(vocabulary)
        held, end = _held[vocabulary], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for lo, hi in runs_of_texts(rows):
                for i, raw in zip(ids[lo:hi], held.encode(rows[lo:hi]), strict=True):
                    raw += end
                    out += [(i, k, k * capacity, len(cut) // 4, zlib.crc32(cut)) for k, cut in enumerate(raw[at : at + 4 * capacity] for at in range(0, len(raw), 4 * capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return columns(docs, id_col, text=text_col).mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Null and empty texts have the end id alone. Repeated rows are packed each. An empty table
    gives an empty result. Only the histogram of lengths and the plan, both bounded by the
    capacity, reach the driver; ranks within a length come from windows over slices of its
    rows, so a length that very many documents share isn't sorted in one task.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    rows = work.write(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    slots = Slots(plan(counts, capacity).patterns)
    slices = max(8, sum(counts.values()) // 500_000)
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    within = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1)
    sums = sliced.groupBy("length", "slice").count()
    before = sums.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = within.join(before.select("length", "slice", F.coalesce("before", F.lit(0)).alias("before")), ["length", "slice"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, offset = slots.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, (F.col("rank") + F.col("before")).alias("rank")).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
