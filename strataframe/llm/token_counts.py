"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strataframe.llm.common import columns, leanly, runs_of_texts

#: Entries of the per-worker memo of counted units; it starts anew beyond that.
MEMO = 400_000
PAIR = re.compile(r"\s\s")
#: The pre-tokens of byte-level vocabularies, for texts of Latin letters, ASCII digits and signs.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
STABLE = re.compile("[\x20-\x7e\u00c0-\u024f]*").fullmatch
OTHER = re.compile(r"[^\S\n ]")
NONE = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes are themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Byte-pair merges of many pre-tokens at once.

    Vocabularies whose last symbol of a pre-token has a suffix are merged alike. The merges must
    be ranked as they were learned: none makes a symbol whose own merges come before it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        if spec["model"].get("ignore_merges") or spec["model"].get("dropout"):
            raise ValueError("vocabularies that ignore or drop merges aren't supported")
        self.to_byte = byte_symbols()
        self.first, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for ch, b in self.to_byte.items():
            self.first[b], self.last[b] = vocab[ch], vocab[ch + suffix]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        made = np.full(max(vocab.values()) + 1, -1, np.int64)  # the first merge that makes each symbol
        made[self.merged[::-1]] = np.arange(len(pairs))[::-1]
        if len(keys) and (np.maximum(made[keys >> 32], made[keys & 0xFFFFFFFF]) >= np.arange(len(keys))).any():
            raise ValueError("a merge comes before the symbols that it needs")
        # An open hash table: pairs that find their slot taken go to the next one.
        self.bits = int(2 * len(keys)).bit_length() + 2
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == -1
            put = np.flatnonzero(free)
            _, one = np.unique(slot[put], return_index=True)
            put = put[one]
            self.keys[slot[put]] = keys[todo[put]]
            self.rank[slot[put]] = todo[put]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 32 | right
        slot = self._slot(want)
        held = self.keys[slot]
        out = np.where(held == want, self.rank[slot], NONE)
        todo = np.flatnonzero((held != want) & (held != -1))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held, sought = self.keys[slot], want[todo]
            out[todo[held == sought]] = self.rank[slot[held == sought]]
            on = (held != sought) & (held != -1)
            todo, slot = todo[on], slot[on]
        return out

    def merge(self, raw: np.ndarray, sizes: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """For tokens of so many bytes, end to end: the ids that survive all merges, and their number in each; without ``ids`` the number alone."""
        out = sizes.copy()
        sym = self.first[raw]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        sym[ends] = self.last[raw[ends]]
        done = [(np.flatnonzero(sizes == 1), sym[np.repeat(sizes == 1, sizes)])]
        live = np.flatnonzero(sizes > 1)
        sym = sym[np.repeat(sizes > 1, sizes)]
        size = sizes[live]
        while len(live):
            start = np.cumsum(size) - size
            last = start + size - 1
            rank = np.full(len(sym), NONE)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[last] = NONE
            low = np.minimum.reduceat(rank, start)
            hit = (rank == np.repeat(low, size)) & (rank != NONE)
            # Of overlapping pairs (a a a) every second one merges, from the left.
            where = np.flatnonzero(hit)
            fresh = np.ones(len(where), bool)
            fresh[1:] = where[1:] != where[:-1] + 1
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - begin) % 2 == 0]
            sym[where] = self.merged[rank[where]]
            gone = np.zeros(len(sym), bool)
            gone[where + 1] = True
            size = size - np.add.reduceat(gone, start, dtype=np.int64)
            sym = sym[~gone]
            stay = (low != NONE) & (size > 1)
            out[live] = size
            on = np.repeat(stay, size)
            if ids:
                done.append((live[~stay], sym[~on]))
            sym, live, size = sym[on], live[stay], size[stay]
        if not ids:
            return sym, out
        first = np.cumsum(out) - out
        flat = np.empty(int(out.sum()), np.int64)
        for which, held in done:
            n = out[which]
            flat[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(len(held))] = held
        return flat, out

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols of each token survive all merges."""
        return self.merge(np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens)), ids=False)[1]


class TokenCounter:
    """Counts of whole texts; the vocabulary's library splits texts, the merges are done here."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merger = RankMerger(path)
        library = Tokenizer.from_file(path)
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.special = sorted((x.content for x in library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.memo: dict[str, int] = {}  # of words: after a line's end where the key starts with one, else after a space

    def _count_pieces(self, pieces: list[str | bytes]) -> np.ndarray:
        at = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        counts = self.merger.count([p if isinstance(p, bytes) else p.encode() for p in at])
        return counts[np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces))]

    def _count_whole(self, texts: list[str]) -> list[int]:
        """Of texts with any white space."""
        byte = self.merger.to_byte.__getitem__
        split = [[bytes(map(byte, p)) for p, _ in self.split(t)] for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        counts = np.concatenate([[0], np.cumsum(self._count_pieces([p for s in split for p in s]))])
        ends = np.cumsum(sizes)
        return (counts[ends] - counts[ends - sizes]).tolist()

    def _learn(self, keys: list[str]) -> None:
        """Words without white space. Those of letters whose class no Unicode version moves are
        split by the pattern itself, others by the library."""
        units = [k[1:] if k[0] == "\n" else f" {k}" for k in keys]
        split = [[u] if u.isalpha() or u[1:].isalpha() else PIECES(u) for u in units]
        for i, u in enumerate(units):
            if not STABLE(u):
                split[i] = [bytes(map(self.merger.to_byte.__getitem__, p)) for p, _ in self.split(u)]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        counts = np.concatenate([[0], np.cumsum(self._count_pieces([p for s in split for p in s]))])
        ends = np.cumsum(sizes)
        total = counts[ends] - counts[ends - sizes]
        total += np.fromiter((k[0] == "\n" for k in keys), bool, len(keys))
        self.memo.update(zip(keys, total.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Special strings are one token, as the library's default has it.

        One space or one line's end between two other characters always starts a pre-token, and
        the line's end is one of its own. So where white space comes in single characters, words
        are counted once and remembered; other texts are split whole.
        """
        parts, owner, out = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            todo = [t]
            for s in self.special:
                if s in t:
                    pieces = [p.split(s) for p in todo]
                    out[i] += sum(len(p) - 1 for p in pieces)
                    todo = [x for p in pieces for x in p]
            parts += todo
            owner += [i] * len(todo)
        words: list[list[str]] = []
        whole: list[int] = []
        for k, t in enumerate(parts):
            clean = t and not t[0].isspace() and not t[-1].isspace() and not PAIR.search(t)
            words.append(f"\n{t}".replace("\n", " \n")[1:].split(" ") if clean else [])
            if t and not clean:
                whole.append(k)
        wanted = set().union(*words)
        if len(self.memo) + len(wanted) > MEMO + len(wanted & self.memo.keys()):
            self.memo = {}
        new = list(wanted - self.memo.keys())
        odd = [k for k in new if OTHER.search(k)] if any(map(OTHER.search, parts)) else []
        if odd:  # white space that is neither a space nor a line's end, inside a word
            new = list(set(new) - set(odd))
            self.memo.update(zip(odd, self._count_whole([k if k[0] == "\n" else f" {k}" for k in odd]), strict=True))
        for lo in range(0, len(new), 50_000):
            self._learn(new[lo : lo + 50_000])
        get = self.memo.__getitem__
        for i, tail in zip(owner, words, strict=True):
            out[i] += sum(map(get, tail)) - bool(tail)  # but for the line's end put before the text
        for k, n in zip(whole, self._count_whole([parts[k] for k in whole]) if whole else [], strict=True):
            out[owner[k]] += n
        return out


_held: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _held:
        _held[path] = TokenCounter(path)
    return _held[path]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_bytes (UTF-8), n_tokens and over_limit.

    Null and empty texts have no bytes and no tokens. Rows are independent: repeated rows and
    ids give repeated results; an empty table gives an empty result. ``vocabulary`` is the path,
    on every executor, of a byte-level BPE vocabulary in the tokenizers library's format.
    """

    @leanly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counter(vocabulary)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            tokens: list[int] = []
            for lo, hi in runs_of_texts(rows):
                tokens += held.count(rows[lo:hi])
            n = np.array(tokens, np.int64)
            sizes = pa.array([len(x.encode()) for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), sizes, pa.array(n), pa.array(n > limit)], schema=SCHEMA)

    return columns(docs, id_col, text=text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
