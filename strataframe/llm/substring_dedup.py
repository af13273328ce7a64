"""Removal of repeated word sequences: documents are factored against indexed reference blocks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import Workspace, leanly, mix, ragged, shuffle_parts

#: Words of the sequences by which candidates meet.
GRAM = 6
#: Documents with one anchor from which on its windows are dealt one by one.
HOT = 1000
#: Bytes of text looked at together, bytes of cuttings to a bucket, and words of a reference block.
SLICE = 2_000_000
BUCKET = 3_000_000
BLOCK = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ROLL = 0x100000001B3


def pieces(raw: bytes, overlap: int, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of stretches of a text of about ``most`` bytes; each begins with the last words of the one before."""
    at, first, words = 0, 0, []
    while at < len(raw):
        end = at + most
        if end < len(raw):
            gap = _SPACE.search(raw, end)
            end = gap.start() if gap else len(raw)
        held = words[len(words) - overlap :] if overlap and words else []
        first += len(words) - len(held)
        words = held + raw[at:end].split()
        yield first, words
        at = end


class Stretch:
    """Consecutive texts, or a part of a long one, as words, with the windows of ``width`` words grouped by anchor.

    A window's anchor is the sequence of GRAM words in it with the smallest hash, the leftmost of
    equals, so equal windows have equal anchors. A group is a run of windows with one anchor:
    ``doc`` is its text, ``first`` its first window's place among ``words``, ``base`` what to add
    for the place in the text, ``count`` the windows, ``hash`` the anchor's hash.
    """

    def __init__(self, held: list[tuple[int, int, list[bytes]]], width: int):
        self.words = [w for _, _, ws in held for w in ws]
        known = {w: xxhash.xxh3_64_intdigest(w) for w in set(self.words)}
        self.ids = np.fromiter(map(known.__getitem__, self.words), np.uint64, len(self.words))
        size = np.array([len(ws) for _, _, ws in held], np.int64)
        start = np.cumsum(size) - size
        windows = np.maximum(size - width + 1, 0)
        piece = np.repeat(np.arange(len(held)), windows)
        at = ragged(start, windows)
        grams = self.hash_at(np.arange(max(0, len(self.ids) - GRAM + 1)), GRAM)
        spread = width - GRAM + 1
        least = np.lib.stride_tricks.sliding_window_view(grams, spread).argmin(1) if len(at) else at
        anchor = at + least[at]
        fresh = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])][: len(at)])
        self.first, self.count = at[fresh], np.diff(np.r_[fresh, len(at)])
        self.hash = grams[anchor[fresh]]
        self.doc = np.array([d for d, _, _ in held], np.int64)[piece[fresh]]
        self.base = (np.array([f for _, f, _ in held], np.int64) - start)[piece[fresh]]

    def hash_at(self, at: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n words from each place on."""
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * np.uint64(_ROLL) + self.ids[at + k]
        return mix(h)


def stretches(texts: list[bytes], width: int) -> Iterator[Stretch]:
    held: list[tuple[int, int, list[bytes]]] = []
    size = 0
    for i, raw in enumerate(texts):
        for first, words in pieces(raw, width - 1, SLICE):
            if len(words) < width:
                continue
            held.append((i, first, words))
            size += min(len(raw), SLICE)
            if size >= SLICE:
                yield Stretch(held, width)
                held, size = [], 0
    if held:
        yield Stretch(held, width)


# ---- reference blocks -------------------------------------------------------------------------


class Block:
    """An index of the word suffixes of some segments, sorted by their first ``width`` words.

    Suffixes that share these words are a class; a class knows its smallest document and where
    that one has it. Suffixes within ``width`` of their segment's end are left out.
    """

    def __init__(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int):
        self.ids, self.width = ids, width
        windows = size - width + 1
        at = ragged(start, windows)
        owner = np.repeat(doc, windows)
        # Doubling: sequences of n words are numbered in order, then those of 2 n by two numbers.
        name, n = ids.astype(np.int64), 1
        while 2 * n <= width:
            name, n = self._numbered(name[: len(name) - n], name[n:]), 2 * n
        name = self._numbered(name[at], name[at + width - n])
        order = np.lexsort((owner, name))
        head = np.flatnonzero(np.r_[True, np.diff(name[order]) != 0][: len(order)])
        self.source, self.least = at[order[head]], owner[order[head]]
        self.first = ids[self.source]

    @staticmethod
    def _numbered(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.unique(one << 32 | two, return_inverse=True)[1]

    def find(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The class of the ``width`` words from each place of other words on, or -1."""
        low = np.searchsorted(self.first, ids[at], "left")
        high = np.searchsorted(self.first, ids[at], "right")
        end = high.copy()
        while (go := np.flatnonzero(low < high)).size:
            mid = (low[go] + high[go]) // 2
            less = self._compare(mid, ids, at[go]) < 0
            low[go[less]] = mid[less] + 1
            high[go[~less]] = mid[~less]
        out = np.full(len(at), -1, np.int64)
        inside = np.flatnonzero(low < end)
        same = self._compare(low[inside], ids, at[inside]) == 0
        out[inside[same]] = low[inside[same]]
        return out

    def _compare(self, classes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(1, self.width):
            mine, theirs = self.ids[self.source[classes[todo]] + k], ids[at[todo] + k]
            out[todo] = np.sign(mine - theirs)
            todo = todo[mine == theirs]
            if not len(todo):
                break
        return out


def factors(block: Block, ids: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, words) of factors of ``width`` words or more that a document before the segment's has in the block.

    All segments are parsed at once, each greedily from the left: the words at its place are
    looked up, and a factor goes on as long as its source does. Windows that start in a factor
    and end behind it aren't told by it, so the parse goes on with the first of them. Without a
    factor of that length it goes on with the next word. ``ids`` ends each segment with a
    number that no word has.
    """
    width, found = block.width, []
    lane = np.arange(len(start))
    place = np.zeros(len(start), np.int64)
    while (lane := lane[place[lane] + width <= size[lane]]).size:
        at = start[lane] + place[lane]
        cls = block.find(ids, at)
        hit = (cls >= 0) & (block.least[cls] < doc[lane])
        some, source, text = lane[hit], block.source[cls[hit]], at[hit]
        long = np.full(len(some), width, np.int64)
        going = np.arange(len(some))
        while (going := going[(place[some[going]] + long[going] < size[some[going]])]).size:
            going = going[block.ids[source[going] + long[going]] == ids[text[going] + long[going]]]
            long[going] += 1
        found.append((some, place[some], long))
        place[lane[~hit]] += 1
        place[some] += long - width + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def repeated_in(segments: list[bytes], doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, words): stretches of distinct segments that documents before theirs have, by factoring.

    Segments go by document into reference blocks of BLOCK words; a segment is parsed against its
    own block and each before it, as no later one has an earlier document.
    """
    order = np.argsort(doc, kind="stable")
    split = [segments[k].split() for k in order]
    number = {w: k for k, w in enumerate({w for ws in split for w in ws}, 1)}
    size = np.fromiter(map(len, split), np.int64, len(split))
    stop = len(number) + 1
    ids = np.fromiter((k for ws in split for k in (*map(number.__getitem__, ws), stop)), np.int64, int(size.sum()) + len(size))
    start = np.cumsum(size + 1) - size - 1
    cut = np.r_[np.searchsorted(start // BLOCK, np.arange(int(start[-1]) // BLOCK + 1)), len(split)] if len(split) else np.zeros(1, np.int64)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if a == b:
            continue
        lo, hi = int(start[a]), int(start[b - 1] + size[b - 1] + 1)
        block = Block(ids[lo:hi], start[a:b] - lo, size[a:b], doc[order[a:b]], width)
        seg, place, long = factors(block, ids, start[a:], size[a:], doc[order[a:]])
        out.append((order[a + seg], place, long))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


# ---- stages -----------------------------------------------------------------------------------

_RUN = "doc_id long, mark long, lo long, hi long"


def repeated_runs(docs: DataFrame, width: int, work: Workspace) -> DataFrame:
    """(doc_id, mark, lo, hi): ranges of words covered by windows that start in a document of a smaller id too.

    ``docs`` has doc_id, mark (a hash of the text) and text. A window can only repeat where its
    anchor does, so anchors of one document alone are left out first, by an aggregate that
    combines before it shuffles. The windows around the others are cut out and dealt to buckets
    by anchor, or one by one by their own words where an anchor is hot, so that equal windows
    meet and no bucket grows with a hot one. A bucket's cuttings are its reference blocks.
    """
    spark = docs.sparkSession

    @leanly
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in stretches(batch.column(2).cast(pa.binary()).to_pylist(), width):
                pair = np.unique(np.stack([s.doc, s.hash.view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pair[:, 0]]), pa.array(marks[pair[:, 0]]), pa.array(np.ascontiguousarray(pair[:, 1]))], ["doc_id", "mark", "hash"])

    found = work.write(docs.select("doc_id", "mark", "text").mapInArrow(anchors, "doc_id long, mark long, hash long"), "anchors")
    shared = found.groupBy("hash").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("two"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("one < two").select("hash", (F.col("n") > HOT).alias("hot"))
    marked = found.join(shared, "hash").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("hash", "hot")).alias("anchors"))
    marked = work.write(marked.select("doc_id", "mark", F.col("anchors.hash").alias("hashes"), F.expr("transform(filter(anchors, a -> a.hot), a -> a.hash)").alias("hot")), "marked")
    del found, shared
    work.drop("anchors")

    @leanly
    def cuttings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted, hot = (_by_row(batch.column(k)) for k in (3, 4))
            for s in stretches(batch.column(2).cast(pa.binary()).to_pylist(), width):
                keep = np.flatnonzero(np.isin(_tagged(s.hash, s.doc), wanted))
                doc, first, count, base, key = s.doc[keep], s.first[keep], s.count[keep], s.base[keep], s.hash[keep]
                often = np.isin(_tagged(key, doc), hot)
                if often.any():
                    # Windows of hot anchors go alone, each by its own words.
                    each = np.where(often, count, 1)
                    lone = np.repeat(often, each)
                    first = ragged(first, each)
                    doc, base, key, count = (np.repeat(x, each) for x in (doc, base, key, count))
                    count = np.where(lone, 1, count)
                    key = key.copy()
                    key[lone] = s.hash_at(first[lone], width)
                yield from deal(s.words, ids[doc], marks[doc], base, first, count, key)

    def deal(words: list[bytes], doc: np.ndarray, mark: np.ndarray, base: np.ndarray, first: np.ndarray, count: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Equal cuttings of a batch go as one, that of the smallest document; it covers the others whole.

        A document that has a cutting often sends it once, with its places.
        """
        ends = first + count + width - 1
        text = [b" ".join(words[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        number: dict[bytes, int] = {}
        same = np.fromiter((number.setdefault(t, len(number)) for t in text), np.int64, len(text))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc)
        later = doc > least[same]
        rest = np.flatnonzero(~later)
        done = _runs(doc[later], mark[later], (base + first)[later], (base + ends)[later])
        rest = rest[np.lexsort(((base + first)[rest], mark[rest], same[rest]))]
        fresh = np.flatnonzero(np.r_[True, (same[rest[1:]] != same[rest[:-1]]) | (mark[rest[1:]] != mark[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]])][: len(rest)])
        head, held = rest[fresh], len(done)
        places = pa.ListArray.from_arrays(pa.array(np.r_[fresh, len(rest)].astype(np.int32)), pa.array((base + first)[rest]))
        columns = [
            pa.concat_arrays([pa.array(key[head].view(np.int64)), pa.nulls(held, pa.int64())]),
            pa.concat_arrays([pa.array([text[k] for k in head], pa.binary()), pa.nulls(held, pa.binary())]),
            pa.concat_arrays([places, pa.nulls(held, pa.list_(pa.int64()))]),
            *(pa.concat_arrays([pa.array(x[head]), y]) for x, y in zip((doc, mark), done.columns, strict=False)),
            *(pa.concat_arrays([pa.nulls(len(head), pa.int64()), y]) for y in done.columns[2:]),
        ]
        if len(head) + held:
            yield pa.RecordBatch.from_arrays(columns, ["key", "words", "places", "doc_id", "mark", "lo", "hi"])

    @leanly
    def covered(group: pa.Table) -> pa.Table:
        text = group.column("words").to_pylist()
        doc, mark = (group.column(c).to_numpy() for c in ("doc_id", "mark"))
        places = group.column("places").combine_chunks()
        lo, often = places.flatten().to_numpy(), places.value_lengths().to_numpy()
        number: dict[bytes, int] = {}
        same = np.fromiter((number.setdefault(t, len(number)) for t in text), np.int64, len(text))
        size = np.fromiter((t.count(b" ") + 1 for t in number), np.int64, len(number))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc)
        seg, place, long = repeated_in(list(number), least, width)
        doc, mark, same = (np.repeat(x, often) for x in (doc, mark, same))
        later = doc > least[same]
        # Each row of a segment's smallest document loses the segment's repeated stretches.
        order = np.argsort(seg, kind="stable")
        seg, place, long = seg[order], place[order], long[order]
        own = np.flatnonzero(~later)
        a, b = (np.searchsorted(seg, same[own], side) for side in ("left", "right"))
        at, row = ragged(a, b - a), np.repeat(own, b - a)
        out = [(doc[later], mark[later], lo[later], lo[later] + size[same[later]]), (doc[row], mark[row], lo[row] + place[at], lo[row] + place[at] + long[at])]
        return pa.Table.from_batches([_runs(*(np.concatenate(x) for x in zip(*out, strict=True)))])

    joined = docs.join(marked, ["doc_id", "mark"]).select("doc_id", "mark", "text", "hashes", "hot")
    cut = work.write(joined.mapInArrow(cuttings, f"key long, words binary, places array<long>, {_RUN}"), "cuttings")
    del joined, marked
    work.drop("marked")
    total = cut.agg(F.coalesce(F.sum(F.octet_length("words") + 40 + 8 * F.size("places")), F.lit(0))).first()[0]
    buckets = max(shuffle_parts(spark), int(total) // BUCKET + 1)
    rest = cut.where("key is not null").select(F.pmod("key", F.lit(buckets)).alias("bucket"), "words", "places", "doc_id", "mark").groupBy("bucket").applyInArrow(covered, _RUN)
    out = work.write(cut.where("key is null").select("doc_id", "mark", "lo", "hi").unionByName(rest), "runs")
    del cut, rest
    work.drop("cuttings")
    return out


def _tagged(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(value ^ row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _by_row(lists: pa.ListArray) -> np.ndarray:
    """The values of all lists, each mixed with its row's number."""
    return _tagged(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()))


def _runs(doc: np.ndarray, mark: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Ranges of words, those that touch or overlap as one."""
    order = np.lexsort((lo, mark, doc))
    doc, mark, lo, hi = doc[order], mark[order], lo[order], hi[order]
    if len(doc):
        same = (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1])
        group = np.cumsum(np.r_[True, ~same]) - 1
        # Ends so far, within a group: a group's ends lie above those of the groups before it.
        span = int(hi.max()) + 1
        reach = np.maximum.accumulate(hi + group * span) - group * span
        fresh = np.flatnonzero(np.r_[True, ~same | (lo[1:] > reach[:-1])])
        hi = np.maximum.reduceat(hi, fresh)
        doc, mark, lo = doc[fresh], mark[fresh], lo[fresh]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, mark, lo, hi)], ["doc_id", "mark", "lo", "hi"])


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str, bytes]:
    """Number of words, those removed, the digest of what is kept and the kept words, joined by one space."""
    edges, at = [], 0
    for lo, hi in sorted(spans):
        if hi > at:
            edges.append((max(lo, at), hi))
            at = hi
    n, kept = 0, []
    for first, words in pieces(raw, 0, SLICE):
        n = first + len(words)
        here = first
        for lo, hi in [e for e in edges if e[1] > first and e[0] < n]:
            kept += words[here - first : max(lo, here) - first]
            here = hi
        kept += words[here - first :] if here < n else []
    left = b" ".join(kept)
    return n, sum(hi - lo for lo, hi in edges), hashlib.sha256(left).hexdigest(), left


def substring_dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_words, n_removed, kept_sha256 and kept_text.

    Words are runs of anything but ASCII white space. Removed is each word covered by a sequence
    of ``width`` words (GRAM at least) that also starts in a document with a smaller id;
    sequences are judged on the input. What is kept is joined by one space. Null and empty
    texts, and those of fewer words, lose nothing; neither do rows without an id, which are no
    source either. Rows that repeat an id are judged alike and aren't sources for one another.
    An empty table gives none. Only the two named columns are read, whatever others are called.
    Very long texts are read in stretches of SLICE bytes that overlap by a window.
    """
    if width < GRAM:
        raise ValueError(f"width is {GRAM} at least")
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    found = repeated_runs(rows.where("doc_id is not null").select("doc_id", "mark", "text"), width, Workspace(docs.sparkSession, "substring-dedup"))
    spans = found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    @leanly
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, held in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                out.append(_kept(raw, [(s["lo"], s["hi"]) for s in held.as_py()] if held.is_valid else []))
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 4, [pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:3], made[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = rows.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
