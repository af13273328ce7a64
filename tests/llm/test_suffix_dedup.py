import hashlib
import random

import numpy as np
import pytest

from strataframe.llm import suffix_dedup as sd


def brute(docs, width=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(first.get(b[k : k + width], i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = [True] * width
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randrange(1, 8))) for _ in range(200)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    docs = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 80)))
        for _ in range(rng.randrange(3)):
            lo = rng.randrange(len(passage))
            t += passage[lo : lo + rng.randrange(20, 120)] + rng.choice(words)
        if docs and rng.random() < 0.3:
            t = (rng.choice(docs)[1] or "") + rng.choice(["", "x", t])
        docs.append((i * 37 % 997, t))
    return docs + [(2000, None), (2001, ""), (2002, "ab" * 400), (2003, "ab" * 300), (2004, "ab" * 24)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 700)
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sd.suffix_dedup(df).drop("kept_text").collect()
    assert sorted(map(tuple, got)) == brute(docs)


@pytest.mark.parametrize("most", [10**6, 1500, 700, 300])
def test_shards_merge(most):
    rng = random.Random(3)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(400))
    segs = []
    for _ in range(60):
        o, n = rng.randrange(300), rng.randrange(24, 90)
        segs.append(base[o : o + n] if rng.random() < 0.8 else bytes(rng.choice(b"abcdefgh ") for _ in range(n)))
    size = np.array(list(map(len, segs)))
    docs = np.array(rng.sample(range(100), 60))
    first = {}
    for d, s in zip(docs, segs, strict=True):
        for i in range(len(s) - 23):
            first[s[i : i + 24]] = min(first.get(s[i : i + 24], 999), d)
    want = [first[s[i : i + 24]] for s in segs for i in range(len(s) - 23)]
    text = np.frombuffer(b"".join(segs), np.uint8)
    assert sd.smallest_documents(text, np.cumsum(size) - size, size, docs, 24, most).tolist() == want


def test_suffix_array_and_prefixes():
    rng = random.Random(5)
    b = bytes(rng.choice(b"ab") for _ in range(900)) + b"abcd" * 100
    text = np.frombuffer(b, np.uint8)
    sa, rank = sd.suffix_array(text)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    lcp = sd.common_prefixes(text, sa, rank, 50)
    for r in range(1, len(b)):
        i, j, k = sa[r], sa[r - 1], 0
        while k < 50 and max(i, j) + k < len(b) and b[i + k] == b[j + k]:
            k += 1
        assert lcp[i] == k


def test_empty_null_ids_and_clashing_columns(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "a passage of some length that two of the documents share, word for word"
    df = spark.createDataFrame([(None, t, 1), (4, t, 1), (7, t, 1), (7, t, 1)], "doc_id long, text string, mark int")
    got = sorted((str(r.doc_id), r.n_removed) for r in sd.suffix_dedup(df).collect())
    assert got == [("4", 0), ("7", len(t)), ("7", len(t)), ("None", 0)]


def test_strings_of_one_hash_are_told_apart(monkeypatch):
    text = np.frombuffer(b"abcdefghijkl" * 3 + b"abcdefghijkX", np.uint8)
    at = np.array([0, 12, 1, 24, 36, 13, 2])
    want = [bytes(text[a : a + 12]) for a in at]
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(sd, "mix", lambda h: h * np.uint64(0))
        got = sd.equal_strings(text, at, 12).tolist()
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(at)) for j in range(len(at)))


def test_shards_meet_in_one_sort(monkeypatch):
    calls = []
    real = sd.equal_strings
    monkeypatch.setattr(sd, "equal_strings", lambda *a: calls.append(len(a[1])) or real(*a))
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 6000).astype(np.uint8)
    size = np.full(100, 60)
    docs = rng.permutation(100)
    got = sd.smallest_documents(text, np.cumsum(size) - size, size, docs, 30, most=300)
    least: dict[bytes, int] = {}
    strings = [(bytes(text[60 * k + j : 60 * k + j + 30]), docs[k]) for k in range(100) for j in range(31)]
    for s, d in strings:
        least[s] = min(least.get(s, d), d)
    assert got.tolist() == [least[s] for s, _ in strings]
    assert len(calls) == 1 and calls[0] <= len(strings)  # each class once, however many shards
