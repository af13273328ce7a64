"""Removal of repeated byte strings by suffix arrays over shards of candidate text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import Workspace, leanly, mix, pack, ragged, shuffle_parts, unpack

#: Bytes of the strings by which candidates meet.
GRAM = 16
#: Bytes of text of one slice; positions in it fit into 20 bits.
SLICE = 1_000_000
#: Bytes of one suffix array, of the input text to a bucket, and of the cuttings looked at together.
SHARD = 2_000_000
BUCKET = 5_000_000
TOGETHER = 3_000_000
_LOW = np.uint64((1 << 20) - 1)
_ROLL = 0x100000001B3


# ---- candidates -------------------------------------------------------------------------------


def _grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position."""
    h, n = buf.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = h[: len(h) - n] * np.uint64(pow(_ROLL, n, 1 << 64)) + h[n:]
        n *= 2
    return mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


class Slice:
    """Some texts, or a part of a long one, end to end, and their windows grouped by anchor.

    A window's anchor is the gram in it with the smallest hash, the leftmost of equals, so equal
    windows have equal anchors. ``first`` and ``count`` are the windows of each anchor, ``piece``
    its text, ``hash`` its gram's hash.
    """

    def __init__(self, parts: list[tuple[int, int, bytes]], width: int):
        self.buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        size = np.array([len(p[2]) for p in parts], np.int64)
        self.start = np.cumsum(size) - size
        self.doc = np.array([p[0] for p in parts], np.int64)
        self.base = np.array([p[1] for p in parts], np.int64)
        windows = np.maximum(size - width + 1, 0)
        piece = np.repeat(np.arange(len(parts)), windows)
        if not len(piece):
            self.first = self.count = self.piece = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        grams = _grams(self.buf)
        least = _sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), width - GRAM + 1)
        at = self.start[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        anchor = (least[at] & _LOW).astype(np.int64)
        fresh = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
        self.first, self.piece = at[fresh], piece[fresh]
        self.count = np.diff(np.r_[fresh, len(at)])
        self.hash = grams[anchor[fresh]]


def slices(texts: list[bytes], width: int) -> Iterator[Slice]:
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < width:
            continue
        for lo in range(0, len(t) - width + 1, SLICE - width + 1):
            part = t[lo : lo + SLICE]
            if held and size + len(part) > SLICE:
                yield Slice(held, width)
                held, size = [], 0
            held.append((i, lo, part))
            size += len(part)
    if held:
        yield Slice(held, width)


def by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return ((b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1])


# ---- suffix arrays ----------------------------------------------------------------------------


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a big-endian number; zeros follow the text."""
    x = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        x = (x[: len(x) - n] << np.uint64(8 * n)) | x[n:]
    return x[: len(text)]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and each position's rank.

    Larsson-Sadakane refinement: suffixes are ranked by their first bytes, then groups of equal
    rank are split by the rank of what follows the bytes compared so far, which doubles them.
    Groups of one are never touched again. A group, what follows and the position share one
    64-bit number where the text is short enough, so that a round is a plain sort.
    """
    n = len(text)
    bits = max(1, int(n + 1).bit_length())
    if 3 * bits > 64:
        raise ValueError(f"a shard of {n} bytes is too long")
    low = np.uint64((1 << bits) - 1)
    known = (64 - bits) // 8
    first = words_at(text) >> np.uint64(64 - 8 * known)
    packed = np.sort(first << np.uint64(bits) | np.arange(n, dtype=np.uint64))
    sa = (packed & low).astype(np.int64)
    ordered = packed >> np.uint64(bits)
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][:n])
    size = np.diff(np.r_[head, n])
    group = np.repeat(head, size)
    rank = np.empty(n + 1, np.int64)
    rank[sa] = group + 1
    rank[n] = 0  # the text's end comes before all else
    live = np.flatnonzero(np.repeat(size > 1, size))  # places in sa of unsplit groups
    while len(live):
        pos = sa[live]
        follow = rank[np.minimum(pos + known, n)].astype(np.uint64)
        packed = np.sort((group[live].astype(np.uint64) << np.uint64(2 * bits)) | (follow << np.uint64(bits)) | pos.astype(np.uint64))
        pos = (packed & low).astype(np.int64)
        sa[live] = pos
        packed >>= np.uint64(bits)
        heads = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
        size = np.diff(np.r_[heads, len(live)])
        group[live] = np.repeat(live[heads], size)
        rank[pos] = group[live] + 1
        live = live[np.repeat(size > 1, size)]
        known *= 2
    rank[sa] = np.arange(n)
    return sa, rank[:n]


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int, lanes: int = 16384) -> np.ndarray:
    """By position: the length, ``most`` at the most, of the prefix shared with the suffix ranked before it.

    Kasai's walk in text order, where a suffix shares at most one byte less than the one before
    it: many stretches of the text walk at once, and a step compares eight bytes.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = np.concatenate([words_at(text), np.zeros(most + 8, np.uint64)])
    out = np.zeros(n, np.int32)
    edge = np.linspace(0, n, max(1, min(lanes, n // 64)) + 1).astype(np.int64)
    at, end = edge[:-1], edge[1:]
    at, end = at[edge[:-1] < end], end[edge[:-1] < end]
    shared = np.zeros(len(at), np.int64)
    limits = [np.uint64(1 << (8 * k)) for k in range(1, 8)]
    while len(at):
        other = before[at]
        x = words[at + shared] ^ words[np.maximum(other, 0) + shared]
        equal = np.full(len(x), 8, np.int64)
        part = np.flatnonzero(x)
        if len(part):
            y = x[part]
            few = np.zeros(len(part), np.int64)
            for limit in limits:
                few += y < limit
            equal[part] = few
        room = np.where(other >= 0, np.minimum(n - np.maximum(at, other), most), 0)
        shared = np.minimum(shared + equal, room)
        stop = (equal < 8) | (shared >= room)
        out[at[stop]] = shared[stop]
        shared = np.where(stop, np.maximum(shared - 1, 0), shared)
        at = at + stop
        going = at < end
        if not going.all():
            at, end, shared = at[going], end[going], shared[going]
    return out


def shared_by_neighbours(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Whether each place but the first has the string of ``width`` bytes of the place before it in the list."""
    same = np.ones(max(len(at) - 1, 0), bool)
    if len(same):
        words, left = eights(text), np.arange(len(same))
        for k in steps(width):
            left = left[words[at[left] + k] == words[at[left + 1] + k]]
        same[:] = False
        same[left] = True
    return same


class Shard:
    """A suffix array over some segments; classes are the distinct strings of ``width`` bytes at window starts."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, docs: np.ndarray, width: int):
        """starts: positions of windows; docs: the smallest document that has each."""
        _, rank = suffix_array(text)
        at_rank = np.full(len(text), -1, np.int64)
        at_rank[rank[starts]] = np.arange(len(starts))
        ordered = at_rank[at_rank >= 0]
        # A class ends where a window shares less than the width with the one before it in suffix order.
        fresh = np.r_[True, ~shared_by_neighbours(text, starts[ordered], width)][: len(ordered)]
        self.class_of = np.empty(len(starts), np.int64)
        self.class_of[ordered] = np.cumsum(fresh) - 1
        self.at = starts[ordered][fresh]
        self.least = np.minimum.reduceat(docs[ordered], np.flatnonzero(fresh)) if len(starts) else docs[:0]


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, in the machine's order, without a copy."""
    return np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text).data, strides=(1,))


def steps(width: int) -> list[int]:
    """Where eight bytes start that together cover a string of ``width``, eight at least."""
    return [*range(0, width - 8, 8), width - 8]


def equal_strings(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for the string of ``width`` bytes, eight at least, at each place, equal for equal strings; those of one hash are compared in full."""
    words = eights(text)
    key = np.zeros(len(at), np.uint64)
    for k in steps(width):
        w = words[at + k]
        key = key * np.uint64(_ROLL) + (w ^ (w >> np.uint64(29)))
    key = mix(key)
    order = np.argsort(key)
    held = key[order]
    fresh = np.r_[True, held[1:] != held[:-1]][: len(at)]
    group = np.cumsum(fresh) - 1
    number = np.empty(len(at), np.int64)
    number[order] = group
    # Equal hashes of different strings get numbers of their own.
    again = np.flatnonzero(~fresh)
    mine, first = at[order[again]], at[order[np.flatnonzero(fresh)[group[again]]]]
    differs = np.zeros(len(again), bool)
    for k in steps(width):
        differs |= words[mine + k] != words[first + k]
    if differs.any():
        rows = np.flatnonzero(np.isin(number, group[again[differs]]))
        strings = text[at[rows][:, None] + np.arange(width)]
        number[rows] = len(at) + np.unique(strings, axis=0, return_inverse=True)[1].ravel()
    return number


def smallest_documents(text: np.ndarray, start: np.ndarray, size: np.ndarray, docs: np.ndarray, width: int, most: int = SHARD) -> np.ndarray:
    """For every window of distinct segments, in order, the smallest document that has its string.

    Segments are dealt to shards of about ``most`` bytes; each has its own suffix array, and the
    classes of all shards meet in one sort by their strings' hashes.
    """
    windows = size - width + 1
    cut = (np.cumsum(size) - 1) // most
    shards: list[Shard] = []
    places: list[np.ndarray] = []
    for k in range(int(cut[-1]) + 1 if len(cut) else 0):
        some = np.flatnonzero(cut == k)
        if not len(some):
            continue
        lo = int(start[some[0]])
        part = text[lo : int(start[some[-1]] + size[some[-1]])]
        shards.append(Shard(part, ragged(start[some] - lo, windows[some]), np.repeat(docs[some], windows[some]), width))
        places.append(shards[-1].at + lo)
    if len(shards) > 1:
        number = equal_strings(text, np.concatenate(places), width)
        _, number = np.unique(number, return_inverse=True)
        least = np.concatenate([s.least for s in shards])
        lowest = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, number, least)
        ends = np.cumsum([0, *(len(s.least) for s in shards)])
        for s, a, b in zip(shards, ends[:-1], ends[1:], strict=True):
            s.least = lowest[number[a:b]]
    return np.concatenate([s.least[s.class_of] for s in shards]) if shards else docs[:0]


# ---- stages -----------------------------------------------------------------------------------


def same_segments(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each segment, equal for equal contents; contents of one hash are compared in full."""
    if not len(start):
        return np.zeros(0, np.int64)
    words = eights(text)
    each = -(-size // 8)
    power = np.ones(int(each.max()), np.uint64)
    power[1:] = np.cumprod(np.full(len(power) - 1, _ROLL, np.uint64))

    def covering(some: slice | np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words that cover the segments (the last one ends with its segment), their numbers, where segments start."""
        n = each[some]
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n)
        return words[np.repeat(start, n) + np.minimum(8 * k, np.repeat(size[some] - 8, n))], k, first

    key = np.empty(len(start), np.uint64)
    for some in spans_of(size):
        w, k, first = covering(some, start[some])
        key[some] = np.add.reduceat((w ^ (w >> np.uint64(29))) * power[k], first)
    key = mix(key + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, head, number = np.unique(key, return_index=True, return_inverse=True)
    # Equal hashes of different bytes get numbers of their own.
    first = head[number]
    differs = size != size[first]
    check = np.flatnonzero(~differs & (first != np.arange(len(start))))
    for some in spans_of(size[check]):
        like = check[some]
        one, _, at = covering(like, start[like])
        two, _, _ = covering(like, start[first[like]])
        differs[like] = ~np.logical_and.reduceat(one == two, at)
    number = number.copy()
    number[differs] = len(head) + np.flatnonzero(differs)
    return number


def spans_of(size: np.ndarray, most: int = 1 << 19) -> Iterator[slice]:
    """Slices of consecutive segments of about so many bytes together."""
    cut = np.cumsum(size) // most
    edge = np.r_[0, np.flatnonzero(np.diff(cut)) + 1, len(size)]
    return (slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True) if a < b)


def cut_out(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    parts = [text[ragged(start[some], size[some])] for some in spans_of(size)]
    return np.concatenate(parts) if parts else text[:0]


def runs(doc: np.ndarray, mark: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> pa.RecordBatch:
    """Rows of covered bytes: ``count`` windows from ``first`` on; adjoining windows are one run."""
    if len(doc):
        order = np.lexsort((first, mark, doc))
        doc, mark, first, count = doc[order], mark[order], first[order], count[order]
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (first[1:] != first[:-1] + count[:-1])]
        count = np.add.reduceat(count, np.flatnonzero(fresh))
        doc, mark, first = doc[fresh], mark[fresh], first[fresh]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(mark), pa.array(first), pa.array(first + count + width - 1)], ["doc_id", "mark", "lo", "hi"])


def repeated_runs(docs: DataFrame, width: int, work: Workspace) -> DataFrame:
    """(doc_id, mark, lo, hi): byte ranges of strings of ``width`` bytes that start in a document of a smaller id too.

    ``docs`` has doc_id, mark (a hash of the text) and text. A window of ``width`` bytes can only
    repeat where its anchor does. The first stage finds the anchors of two documents or more; a
    batch sends each anchor once, however many of its documents have it. The second cuts out the
    windows around these anchors and deals them by anchor, so that all equal windows meet; equal
    cuttings of a batch go as one. In a bucket, suffix arrays over the distinct cuttings find the
    equal windows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(shuffle_parts(spark), int(total) // BUCKET + 1)

    @leanly
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "payload", "doc_id", "mark", "hash"]
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [(s.doc[s.piece], s.hash) for s in slices(batch.column(2).cast(pa.binary()).to_pylist(), width)]
            if not found:
                continue
            doc, hash_ = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids[doc], hash_))
            doc, hash_ = doc[order], hash_[order]
            once = np.r_[True, (hash_[1:] != hash_[:-1]) | (ids[doc[1:]] != ids[doc[:-1]])]
            head = np.r_[True, hash_[1:] != hash_[:-1]]
            number = np.cumsum(head) - 1
            several = np.bincount(number[once])[number] > 1
            known = np.flatnonzero(several)
            same = np.unique(np.stack([hash_[known].view(np.int64), doc[known]], 1), axis=0)
            none = pa.nulls(len(same), pa.int32())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(same), pa.binary()), pa.array(ids[same[:, 1]]), pa.array(marks[same[:, 1]]), pa.array(np.ascontiguousarray(same[:, 0]))], names)
            send = np.flatnonzero(head)
            for b, at in by_bucket(hash_[send], buckets):
                at = send[at]
                used, slot = np.unique(doc[at], return_inverse=True)
                # Sorted hashes as differences, byte by byte, so that what is small compresses.
                step = np.diff(hash_[at], prepend=np.uint64(0))
                load = pack(step.view(np.uint8).reshape(-1, 8).T, slot.astype(np.uint32), ids[used], marks[used], several[at])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([load], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(3))], names)

    @leanly
    def shared(batch: pa.Table) -> pa.Table:
        hash_, doc, mark, several = [], [], [], []
        for data in batch.column("payload").to_pylist():
            step, slot, ids, marks, many = unpack(data)
            hash_.append(np.cumsum(np.ascontiguousarray(step.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64))
            doc.append(ids[slot])
            mark.append(marks[slot])
            several.append(many)
        hash_, doc, mark, several = (np.concatenate(x) for x in (hash_, doc, mark, several))
        order = np.lexsort((doc, hash_))
        hash_, doc, mark, several = hash_[order], doc[order], mark[order], several[order]
        number = np.cumsum(np.r_[True, hash_[1:] != hash_[:-1]]) - 1
        other = np.r_[False, (hash_[1:] == hash_[:-1]) & (doc[1:] != doc[:-1])]
        yes = (np.bincount(number, other | several) > 0)[number] & ~several  # batches know their own already
        return pa.table({"doc_id": doc[yes], "mark": mark[yes], "hash": hash_[yes].view(np.int64)})

    sent = work.write(docs.select("doc_id", "mark", "text").mapInArrow(anchors, "bucket int, payload binary, doc_id long, mark long, hash long"), "anchors")
    told = sent.where("payload is not null").select("bucket", "payload").groupBy("bucket").applyInArrow(shared, "doc_id long, mark long, hash long")
    own = sent.where("payload is null").select("doc_id", "mark", "hash")
    marked = work.write(told.unionByName(own).groupBy("doc_id", "mark").agg(F.collect_list("hash").alias("hashes")), "marked")
    del sent, told, own
    work.drop("anchors")

    @leanly
    def cuttings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = batch.column(3)
            value, offset = wanted.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(wanted.value_lengths().to_numpy())]
            owner = np.repeat(np.arange(len(ids), dtype=np.uint64), np.diff(offset))
            made, held = [], 0
            for s in slices(batch.column(2).cast(pa.binary()).to_pylist(), width):
                doc = s.doc[s.piece]
                if not len(doc):
                    continue
                lo, hi = offset[doc[0]], offset[doc[-1] + 1]
                mine = mix(s.hash ^ doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                at = np.flatnonzero(np.isin(mine, mix(value[lo:hi] ^ owner[lo:hi] * np.uint64(0x9E3779B97F4A7C15))))
                if not len(at):
                    continue
                size = s.count[at] + width - 1
                made.append((doc[at], s.base[s.piece[at]] + s.first[at] - s.start[s.piece[at]], s.count[at], s.hash[at], cut_out(s.buf, s.first[at], size)))
                held += int(size.sum())
                if held > TOGETHER:
                    yield from deal(made, ids, marks)
                    made, held = [], 0
            if made:
                yield from deal(made, ids, marks)

    def deal(made: list[tuple], ids: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "payload", "doc_id", "mark", "lo", "hi"]
        doc, first, count, hash_, text = (np.concatenate(x) for x in zip(*made, strict=True))
        size = count + width - 1
        start = np.cumsum(size) - size
        number = same_segments(text, start, size)
        least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, number, ids[doc])
        later = ids[doc] > least[number]  # another of these documents has the whole cutting
        done = runs(ids[doc[later]], marks[doc[later]], first[later], count[later], width)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(done), pa.int32()), pa.nulls(len(done), pa.binary()), *done.columns], names)
        rest = np.flatnonzero(~later)
        for b, at in by_bucket(hash_[rest], buckets):
            at = rest[at]
            used, slot = np.unique(doc[at], return_inverse=True)
            load = pack(ids[used], marks[used], slot.astype(np.uint32), first[at], count[at].astype(np.uint8 if width < 200 else np.uint32), cut_out(text, start[at], size[at]))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([load], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(4))], names)

    @leanly
    def covered(batch: pa.Table) -> pa.Table:
        doc, mark, first, count, text = [], [], [], [], []
        for data in batch.column("payload").to_pylist():
            ids, marks, slot, f, c, t = unpack(data)
            doc.append(ids[slot])
            mark.append(marks[slot])
            first.append(f)
            count.append(c.astype(np.int64))
            text.append(t)
        doc, mark, first, count, text = (np.concatenate(x) for x in (doc, mark, first, count, text))
        size = count + width - 1
        start = np.cumsum(size) - size
        number = same_segments(text, start, size)
        _, head, number = np.unique(number, return_index=True, return_inverse=True)
        least = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(least, number, doc)
        hsize = size[head]
        windows = count[head]
        distinct = cut_out(text, start[head], hsize)
        smallest = smallest_documents(distinct, np.cumsum(hsize) - hsize, hsize, least, width)
        begin = np.cumsum(windows) - windows
        # Occurrences in later documents are covered whole; of the others, the windows that an earlier one has.
        later = doc > least[number]
        out = [runs(doc[later], mark[later], first[later], count[later], width)]
        mine = np.flatnonzero(~later)
        at = ragged(begin[number[mine]], count[mine])
        owner = np.repeat(mine, count[mine])
        hit = smallest[at] < doc[owner]
        place = at - np.repeat(begin[number[mine]], count[mine])
        edge = np.r_[True, (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1])]
        heads = np.flatnonzero(edge) if len(owner) else np.zeros(0, np.int64)
        long = np.diff(np.r_[heads, len(owner)])
        keep = hit[heads] if len(heads) else np.zeros(0, bool)
        heads, long = heads[keep], long[keep]
        out.append(runs(doc[owner[heads]], mark[owner[heads]], first[owner[heads]] + place[heads], long, width))
        return pa.Table.from_batches(out)

    joined = docs.join(marked, ["doc_id", "mark"]).select("doc_id", "mark", "text", "hashes")
    cut = work.write(joined.mapInArrow(cuttings, "bucket int, payload binary, doc_id long, mark long, lo long, hi long"), "cuttings")
    del joined, marked
    work.drop("marked")
    rest = cut.where("payload is not null").select("bucket", "payload").groupBy("bucket").applyInArrow(covered, "doc_id long, mark long, lo long, hi long")
    out = work.write(cut.where("payload is null").select("doc_id", "mark", "lo", "hi").unionByName(rest), "runs")
    del cut, rest
    work.drop("cuttings")
    return out


def without_runs(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and how many maximal runs they make."""
    kept, at, removed, count = [], 0, 0, 0
    for lo, hi in sorted(spans):
        if lo > at or not count:
            kept.append(text[at:lo])
            count += 1
            at = lo
        if hi > at:
            removed += hi - at
            at = hi
    kept.append(text[at:])
    return b"".join(kept), removed, count


def suffix_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text and the columns ``carry``.

    Removed is each byte covered by a string of ``width`` bytes (24 at least) that also starts
    in a document with a smaller id; strings are judged on the input. Null and empty texts, and
    those shorter than ``width``, lose nothing; neither do rows without an id, which are no
    source either. Rows that repeat an id are judged alike and aren't sources for one another.
    ``kept_text`` drops the bytes of characters that a removal has cut through.
    """
    carried = [f"_carry{k}" for k in range(len(carry or []))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(x) for c, x in zip(carry or [], carried, strict=True)))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    found = repeated_runs(rows.where("doc_id is not null").select("doc_id", "mark", "text"), width, Workspace(docs.sparkSession, "suffix-dedup"))
    spans = found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    @leanly
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, held in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                left, removed, count = without_runs(raw, [(s["lo"], s["hi"]) for s in held.as_py()] if held.is_valid else [])
                out.append((len(raw), removed, count, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore").encode() if removed else raw))
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 5, [pa.int64()] * 3 + [pa.string(), pa.binary()], strict=True)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *carried])

    kinds = "".join(f", {x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(carry or [], carried, strict=True))
    out = rows.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans", *carried)
    out = out.mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string{kinds}")
    return out.withColumnsRenamed(dict(zip(carried, carry or [], strict=True)))
