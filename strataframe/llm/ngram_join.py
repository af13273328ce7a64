"""Jaccard join of word n-gram sets by grouped prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import Workspace, columns, hashed_words, leanly, mix, pack, ragged, runs_of_texts, shuffle_parts, unpack
from strataframe.llm.components import connected_components

#: Bits of a cell's number in each of the two rows of the frequency sketch that orders shingles; its size is fixed.
CELLS = 21
#: Slices in which tasks' sketches are added up.
SLICES = 16
#: The largest filter of wanted documents has two to this power of bits.
FILTER = 27
#: Prefix entries that one bucket of the join is to hold.
BUCKET = 1_500_000
#: Runs of a shingle up to this many members lose those that could link with none of the others.
PAIRED = 48
#: Members that one verification group holds beside its pivot, and bytes of their sets.
GROUP, GROUP_BYTES = 200, 4_000_000
_ROLL = np.uint64(0x100000001B3)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    flat, size = hashed_words(texts)
    flat = mix(flat)
    ends = np.cumsum(size)
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * _ROLL + flat[k : k + len(rolled)] if len(rolled) else rolled
    rolled = mix(rolled)
    out = []
    for end, n in zip(ends.tolist(), size.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(rolled[end - n : end - words + 1]))
        elif n:
            h = np.uint64(n)
            for x in flat[end - n : end]:
                h = np.uint64((int(h) * int(_ROLL) + int(x)) & (2**64 - 1))
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(rolled[:0])
    return out


def prefix_size(n: int, percent: int) -> int:
    """Elements of an ordered set of size n of which one is shared by any set that similar to it."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def cells_of(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's cell in either row of the sketch, rows end to end."""
    one = (shingles >> np.uint64(64 - CELLS)).astype(np.int64)
    two = ((shingles >> np.uint64(64 - 2 * CELLS)) & np.uint64((1 << CELLS) - 1)).astype(np.int64)
    return one, two + (1 << CELLS)


def wanted_filter(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the ids' hashes, so that other documents' sets needn't be shuffled, and their number's power of two.

    The filter has eight bits an id, 2^FILTER of them at the most; a full one lets all through.
    """
    power = min(FILTER, max(16, int(8 * wanted.count()).bit_length()))
    part = 1 << (power - 5)
    bits = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << power)).alias("bit")).distinct()

    def gather(batch: pa.Table) -> pa.Table:
        held = np.zeros(part, bool)
        held[batch.column("bit").to_numpy() % part] = True
        return pa.table({"slice": batch.column("slice")[:1], "bits": [pack(np.packbits(held))]})

    rows = bits.withColumn("slice", F.floor(F.col("bit") / part).cast("int")).groupBy("slice").applyInArrow(gather, "slice int, bits binary").collect()
    out = np.zeros(1 << power, bool)
    for r in rows:
        out[r["slice"] * part : (r["slice"] + 1) * part] = np.unpackbits(unpack(r["bits"])[0])
    return np.packbits(out), power


class Shingler:
    """Passes over documents; ``docs`` has doc_id and text, null ids and empty sets link with nothing."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent

    def summary(self) -> DataFrame:
        """doc_id, n_shingles and digest; and each task's slices of the frequency sketch."""
        words = self.words

        @leanly
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            cells = np.zeros(2 << CELLS, np.int32)
            seen: set[bytes] = set()
            for batch in batches:
                rows = batch.column(1).to_pylist()
                n, digest = [], []
                for lo, hi in runs_of_texts(rows):
                    for s in shingle_sets(rows[lo:hi], words):
                        d = xxhash.xxh3_128_digest(s.tobytes())
                        n.append(len(s))
                        digest.append(d)
                        if d not in seen:
                            if len(seen) < 200_000:
                                seen.add(d)
                            for at in cells_of(s):
                                np.add.at(cells, at, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names)
            held = np.split(cells, SLICES)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array([pack(x) for x in held], pa.binary())], names)

        names = ["doc_id", "n_shingles", "digest", "slice", "cells"]
        return self.docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, slice int, cells binary")

    def prefixes(self, cells: np.ndarray, buckets: int) -> DataFrame:
        """(bucket, payload, groups): prefix shingles that fall into the bucket, and groups whose key does.

        A group is the documents of one prefix and size; of a batch, its smallest document alone
        has entries: the payload is the documents with their sizes, and each shingle with its
        document and its place in the prefix. ``groups`` has every document with its group's key.
        """
        words, percent = self.words, self.percent

        @leanly
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                seen: dict[bytes, int] = {}
                group: dict[bytes, int] = {}
                doc, size, tokens, places, key = [], [], [], [], []
                for lo, hi in runs_of_texts(rows):
                    for i, s in zip(ids[lo:hi], shingle_sets(rows[lo:hi], words), strict=True):
                        if i is None or not len(s):
                            continue
                        d = xxhash.xxh3_128_digest(s.tobytes())
                        if d in seen:
                            doc[seen[d]] = min(doc[seen[d]], i)
                            continue
                        seen[d] = len(doc)
                        doc.append(i)
                        size.append(len(s))
                        rank = np.minimum(*(cells[at] for at in cells_of(s)))
                        order = np.argsort(rank, kind="stable")[: prefix_size(len(s), percent)]  # s is sorted: ties go by hash
                        key.append(xxhash.xxh3_128_digest(s[order].tobytes(), len(s)))
                        group.setdefault(key[-1], len(tokens))
                        tokens.append(s[order])
                if not doc:
                    continue
                doc, size = np.array(doc, np.int64), np.array(size, np.int64)
                key = np.array(np.frombuffer(b"".join(key), np.uint64)).reshape(-1, 2)
                heads = np.array(sorted(group.values()), np.int64)
                # The smallest document of a group stands for it.
                order = np.lexsort((doc, key[:, 1], key[:, 0]))
                fresh = np.r_[True, (np.diff(key[order, 0]) != 0) | (np.diff(key[order, 1]) != 0)]
                least = np.zeros(len(doc), np.int64)
                least[order] = doc[order[fresh]][np.cumsum(fresh) - 1]
                held = [tokens[i] for i in heads]
                token = np.concatenate(held)
                lens = np.array([len(t) for t in held])
                owner = np.repeat(np.arange(len(heads), dtype=np.int64), lens)
                place = np.minimum(np.arange(len(token)) - np.repeat(np.cumsum(lens) - lens, lens), 65535).astype(np.uint16)
                order, cuts = by_bucket((token % np.uint64(buckets)).astype(np.int64), buckets)
                order2, cuts2 = by_bucket((key[:, 0] % np.uint64(buckets)).astype(np.int64), buckets)
                for b in range(buckets):
                    at, at2 = order[cuts[b] : cuts[b + 1]], order2[cuts2[b] : cuts2[b + 1]]
                    if len(at) + len(at2):
                        used, slot = np.unique(owner[at], return_inverse=True)
                        load = pack(least[heads[used]], size[heads[used]].astype(np.uint32), token[at], slot.astype(np.uint32), place[at])
                        whose = pack(doc[at2], key[at2, 0], key[at2, 1])
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([load], pa.binary()), pa.array([whose], pa.binary())], ["bucket", "payload", "groups"])

        return self.docs.mapInArrow(run, "bucket int, payload binary, groups binary")

    def sets(self, chosen: DataFrame) -> DataFrame:
        """(doc_id, set) of the chosen doc_ids and, as the filter goes, a few others; a row's set is never shuffled here."""
        words = self.words
        bits, power = wanted_filter(chosen)

        @leanly
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).to_numpy()
                some = batch.select([0, 1]).filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
                rows = some.column(1).to_pylist()
                made = [s.tobytes() for lo, hi in runs_of_texts(rows) for s in shingle_sets(rows[lo:hi], words)]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array(made, pa.binary())], ["doc_id", "set"])

        hashed = self.docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << power)).alias("bit"))
        return hashed.mapInArrow(run, "doc_id long, set binary")


class FACTS:
    """A row of the exchange that tells buckets of their documents: a request, or what is known of a document."""

    names: ClassVar = ["part", "bucket", "payload", "doc_id", "group", "low", "high"]
    ddl = "part int, bucket int, payload binary, doc_id long, group long, low long, high long"


def by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def group_heads(loads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents, and the smallest document of the group of each."""
    doc, one, two = (np.concatenate(x) for x in zip(*map(unpack, loads), strict=True))
    order = np.lexsort((doc, two, one))
    doc, one, two = doc[order], one[order], two[order]
    fresh = np.r_[True, (np.diff(one) != 0) | (np.diff(two) != 0)] if len(doc) else np.zeros(0, bool)
    return doc, doc[fresh][np.cumsum(fresh) - 1]


def shared_shingles(payloads: list[bytes], percent: int) -> tuple[np.ndarray, ...]:
    """A bucket's shared shingles: their members' documents, sizes and places, and where each shingle's run starts."""
    doc, size, token, owner, place = [], [], [], [], []
    base = 0
    for data in payloads:
        d, n, t, o, p = unpack(data)
        doc.append(d)
        size.append(n)
        token.append(t)
        owner.append(o.astype(np.int64) + base)
        place.append(p)
        base += len(d)
    doc, size, token, owner, place = (np.concatenate(x) for x in (doc, size, token, owner, place))
    order = np.lexsort((doc[owner], token))
    token, owner, place = token[order], owner[order], place[order]
    fresh = np.r_[True, token[1:] != token[:-1]][: len(token)]
    run = np.cumsum(fresh) - 1
    length = np.bincount(run)[run] if len(run) else run
    n, p = size[owner].astype(np.int64), place.astype(np.int64)
    # Members that could link with another one of their run; long runs keep all of theirs.
    useful = length > PAIRED
    ahead = (np.append(np.flatnonzero(fresh)[1:], len(token))[run] - np.arange(len(token)) - 1) if len(run) else run
    for d in range(1, PAIRED):
        i = np.flatnonzero((ahead >= d) & (length <= PAIRED))
        if not len(i):
            break
        ok = may_link(n[i], p[i], n[i + d], p[i + d], percent) & (owner[i] != owner[i + d])
        useful[i[ok]] = useful[i[ok] + d] = True
    at = np.flatnonzero(useful)
    starts = np.flatnonzero(np.r_[True, run[at][1:] != run[at][:-1]][: len(at)])
    return doc[owner[at]], n[at], p[at], starts


def may_link(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes, and the places of a shared shingle, leave room for the similarity.

    Of a pair's shared shingles some first one has no other before it; for that one the rest of
    either set bounds the overlap. Places beyond 65,535 are held as that, which only weakens the bound.
    """
    most = np.minimum(n1 - p1, n2 - p2)
    return (100 * most >= percent * (n1 + n2 - most)) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))


def ngram_links(docs: DataFrame, words: int, percent: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The documents' summary (doc_id, n_shingles, digest, head) and their components (node, component).

    ``head`` is the smallest id with the same set. Groups of documents with one prefix and size
    stand as one: first each bucket proposes pairs of a shingle's smallest document and its other
    documents, verified in groups around that pivot. Where these links have joined a bucket's
    documents, nothing is left to compare; all other pairs of a shingle are proposed and
    verified in a second round, so no pair that could link is left out.
    """
    spark = docs.sparkSession
    shingler = Shingler(docs, words, percent)
    both = work.write(shingler.summary(), "summary")
    rows = both.where("cells is null").select("doc_id", "n_shingles", "digest")
    sums = both.where("cells is not null").select("slice", "cells")

    def add(batch: pa.Table) -> pa.Table:
        total = np.zeros((2 << CELLS) // SLICES, np.int64)
        for x in batch.column("cells").to_pylist():
            total += unpack(x)[0]
        return pa.table({"slice": batch.column("slice")[:1], "cells": [pack(total)]})

    slices = {r["slice"]: unpack(r["cells"])[0] for r in sums.groupBy("slice").applyInArrow(add, "slice int, cells binary").collect()}
    cells = np.concatenate([slices.get(k, np.zeros((2 << CELLS) // SLICES, np.int64)) for k in range(SLICES)])
    # Only the order of counts matters: in 16 bits they are exact where small, and logarithmic beyond.
    cells = np.where(cells < 32768, cells, 32768 + 700 * np.log2(np.maximum(cells, 32768) / 32768)).astype(np.uint16)
    entries = rows.agg(F.coalesce(F.sum(F.col("n_shingles") * (100 - percent) / 100 + 1), F.lit(0))).first()[0]
    buckets = max(shuffle_parts(spark), int(entries) // BUCKET + 1)

    @leanly
    def lists(batch: pa.Table) -> pa.Table:
        doc, size, place, starts = shared_shingles(batch.column("payload").to_pylist(), percent)
        whose = group_heads(batch.column("groups").to_pylist())
        return pa.table({"bucket": batch.column("bucket")[:1], "payload": [pack(doc, size.astype(np.uint32), place.astype(np.uint16), starts)], "groups": [pack(*whose)]})

    kept = work.write(shingler.prefixes(cells, buckets).groupBy("bucket").applyInArrow(lists, "bucket int, payload binary, groups binary"), "lists")
    heads = rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("head"))
    head_of = work.write(rows.join(heads, "digest", "left"), "heads")
    del both, rows, sums, heads
    work.drop("summary")
    same = head_of.where("head is not null").select("doc_id", "head").distinct()
    sizes = head_of.where("head is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    # An id with several texts is one document: it links what each of its sets is equal to.
    several = head_of.where("head is not null").groupBy("doc_id").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low <> high").select("doc_id")
    several = same.join(several, "doc_id").select(*(f("doc_id", "head").alias(x) for f, x in ((F.least, "a"), (F.greatest, "b")))).where("a <> b")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("groups").to_pylist():
                doc, group = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(group)], ["doc_id", "group"])

    group_of = work.write(kept.select("groups").mapInArrow(told, "doc_id long, group long"), "groups")
    member = work.write(group_of.join(same, "doc_id").select("group", F.col("head").alias("doc_id")).distinct(), "members")
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("payload").to_pylist():
                doc, size, place, starts = unpack(data)
                n, p = size.astype(np.int64), place.astype(np.int64)
                pivot = np.repeat(starts, np.diff(np.r_[starts, len(doc)]))
                ok = may_link(n, p, n[pivot], p[pivot], percent) & (doc != doc[pivot])
                pairs = np.unique(np.stack([doc[pivot][ok], doc[ok]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])

    proposed = kept.select("payload").mapInArrow(stars, "a long, b long").distinct()
    for side in "ab":
        proposed = proposed.join(group_of.withColumnsRenamed({"doc_id": side, "group": f"g{side}"}), side)
    proposed = proposed.where("ga <> gb").select("ga", "gb").distinct()
    expanded = proposed.join(member.withColumnRenamed("group", "gb"), "gb").select(*ordered("ga", "doc_id"))
    within = member.where("group <> doc_id").select(*ordered("group", "doc_id"))
    first = work.write(expanded.unionByName(within).where("a <> b").distinct(), "first")
    links = work.write(verified(first, sizes, shingler, percent).unionByName(several), "links1")
    parts = work.write(connected_components(links, work, "cc"), "parts1")

    # Second round: pairs of a shingle whose documents the first links have not joined.
    placed = member.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("group", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    placed = work.write(placed, "placed")
    spans = placed.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high"))

    # What is known of a bucket's documents: they are asked for and answered in arrays, a row for
    # each bucket and part of the documents.
    part_of = lambda doc: (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    @leanly
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                doc = np.unique(unpack(data)[0])
                order, cuts = by_bucket(part_of(doc), buckets)
                parts = np.flatnonzero(np.diff(cuts)).tolist()
                loads = [pack(doc[order[cuts[p] : cuts[p + 1]]]) for p in parts]
                none = pa.nulls(len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([b] * len(parts), pa.int32()), pa.array(loads, pa.binary()), none, none, none, none], FACTS.names)

    @leanly
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(part_of(batch.column(0).to_numpy()), pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *batch.columns], FACTS.names)

    @leanly
    def answer(batch: pa.Table) -> pa.Table:
        known, asking = batch.filter(batch.column("payload").is_null()), batch.filter(batch.column("payload").is_valid())
        doc = known.column("doc_id").to_numpy()
        order = np.argsort(doc, kind="stable")
        doc, rest = doc[order], [known.column(c).to_numpy()[order] for c in ("group", "low", "high")]
        loads = []
        for data in asking.column("payload").to_pylist():
            want = unpack(data)[0]
            lo, hi = np.searchsorted(doc, want), np.searchsorted(doc, want, side="right")
            at = ragged(lo, hi - lo)
            loads.append(pack(doc[at], *(x[at] for x in rest)))
        return pa.table({"bucket": asking.column("bucket"), "payload": pa.array(loads, pa.binary())})

    requests = kept.select("bucket", "payload").mapInArrow(asked, FACTS.ddl)
    told_of = group_of.join(spans, "group").select("doc_id", "group", "low", "high").mapInArrow(facts, FACTS.ddl)
    marks = requests.unionByName(told_of).groupBy("part").applyInArrow(answer, "bucket int, payload binary")

    @leanly
    def across(one: pa.Table, two: pa.Table) -> pa.Table:
        found = []
        known, *rest = (np.concatenate(x) for x in zip(*map(unpack, two.column("payload").to_pylist()), strict=True)) if two.num_rows else [np.zeros(0, np.int64)] * 4
        order = np.argsort(known)
        for data in one.column("payload").to_pylist():
            doc, size, place, starts = unpack(data)
            at = order[np.searchsorted(known, doc, sorter=order)] if len(doc) else order[:0]
            group, low, high = (x[at] for x in rest)
            n, p = size.astype(np.int64), place.astype(np.int64)
            for lo, hi in zip(starts, np.r_[starts[1:], len(doc)][: len(starts)], strict=True):
                if (low[lo:hi] == high[lo]).all() and (high[lo:hi] == low[lo]).all():
                    continue
                for i in range(lo, hi - 1):
                    j = np.arange(i + 1, hi)
                    j = j[((low[j] != high[i]) | (high[j] != low[i])) & (group[j] != group[i]) & may_link(n[j], p[j], n[i], p[i], percent)]
                    if len(j):
                        found.append(np.stack([np.full(len(j), group[i]), group[j]], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"ga": np.ascontiguousarray(pairs[:, 0]), "gb": np.ascontiguousarray(pairs[:, 1])})

    more = kept.select("bucket", "payload").groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(across, "ga long, gb long").distinct()
    inside = spans.where("low <> high").select(F.col("group").alias("ga"), F.col("group").alias("gb"))
    pairs = more.unionByName(inside)
    for side in "ab":
        pairs = pairs.join(placed.withColumnsRenamed({"group": f"g{side}", "doc_id": side, "part": f"p{side}"}), f"g{side}")
    second = pairs.where("pa <> pb").select(*ordered("a", "b")).distinct().join(first, ["a", "b"], "left_anti")
    second = work.write(second, "second")
    if second.isEmpty():
        return head_of, parts
    links = links.unionByName(work.write(verified(second, sizes, shingler, percent), "links2"))
    return head_of, work.write(connected_components(links, work, "cc2"), "parts2")


def verified(pairs: DataFrame, sizes: DataFrame, shingler: Shingler, percent: int) -> DataFrame:
    """The pairs (a, b) that link, from whole sets; a pivot's partners are compared in groups of bounded bytes.

    ``sizes`` has the largest set of each id; those of linked ids are within the similarity of it.
    """
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = shingler.sets(wanted)  # read once, so not written
    most = F.greatest(F.lit(1), F.least(F.lit(GROUP), F.floor(F.lit(GROUP_BYTES * percent / 800) / F.col("n"))))
    sized = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners")).join(sizes.withColumnRenamed("doc_id", "a"), "a").select("a", F.floor(F.col("partners") / most).cast("int").alias("more"))
    dealt = pairs.join(sized, "a").withColumn("group", F.pmod(F.xxhash64("b"), F.col("more") + 1)).select("a", "group", "b")
    pivots = dealt.select("a", "group", F.col("a").alias("b")).distinct()

    @leanly
    def compare(batch: pa.Table) -> pa.Table:
        a, b = batch.column("a")[0].as_py(), batch.column("b").to_pylist()
        column = batch.column("set")
        view = lambda i: np.frombuffer(column[i].as_buffer(), np.uint64)
        mine = [view(i) for i, other in enumerate(b) if other == a]
        out = set()
        for i, other in enumerate(b):
            if other != a and other not in out:
                s = view(i)
                for own in mine:
                    at = np.searchsorted(own, s)
                    both = int((own[np.minimum(at, len(own) - 1)] == s).sum())
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        out.add(other)
                        break
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    # Sets are too large to be broadcast on either side, also where the pairs are few.
    with_sets = dealt.unionByName(pivots).hint("merge").join(sets.withColumnRenamed("doc_id", "b").hint("merge"), "b")
    return with_sets.select("a", "group", "b", "set").groupBy("a", "group").applyInArrow(compare, "a long, b long")


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_shingles and component_id, the smallest id that links reach.

    Sets of lower-cased word n-grams link when 100 * intersection >= percent * union. Texts with
    fewer words have their whole sequence as one n-gram; null, empty and wordless texts have an
    empty set and link with nothing, and so do rows without an id (their component is null).
    Rows that repeat an id are one document, which links with what any of its texts links with.
    N-grams are compared as 64-bit hashes. Very long texts are held whole, one at a time. Pairs
    that earlier links have already joined aren't verified, so links aren't counted.
    """
    rows = columns(docs, id_col, text=text_col).withColumnRenamed(id_col, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    head_of, parts = ngram_links(rows, words, percent, Workspace(docs.sparkSession, "ngram-join"))
    return head_of.join(parts.withColumnRenamed("node", "head"), "head", "left").select("doc_id", "n_shingles", F.coalesce("component", "head", "doc_id").alias("component_id"))
