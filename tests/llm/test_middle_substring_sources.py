import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from strataframe.llm import fill_in_middle as fim
from strataframe.llm import source_divergence as sv
from strataframe.llm import substring_dedup as sd

DOCS = "doc_id long, text string"
WORD = r"[^\x20\x09-\x0D]+"
ODD = ["", " ", "a", " a", "a ", " \t\n", "a b", "  a\n\nb  ", "é 日本 🙂x\x85y\xa0z \x0b", "x <P> y", "a <S>b", "<M", "< P>", "<P", "w " * 3000, "x" * 5000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in the middle


def test_fill_in_middle(spark):
    rng = random.Random(1)
    texts = [*ODD, None, *["".join(rng.choice("ab é<PS>M \n\t") for _ in range(rng.randrange(60))) for _ in range(300)]]
    docs = [(i * 7, t) for i, t in enumerate(texts)] + [(7, texts[1])]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], f"{DOCS}, output string, n int").repartition(3)
    made = fim.fill_in_middle(df, carry=["output"])
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output"]
    made = fim.fill_in_middle(df)
    rows = made.withColumn("back", fim.restored(made.output, made.form)).collect()
    assert len(rows) == len(docs)
    forms = Counter()
    for r in rows:
        t = texts[r.doc_id // 7] or ""
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        h = [int(sha(f"42:{r.doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        want = (len(tokens), "plain", None, None, t)
        if t and not any(x in t for x in ("<P>", "<S>", "<M>")) and h[2] % 100 < 50:
            spm = h[3] % 100 < 80
            want = (len(tokens), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")
        assert tuple(r)[1:6] == want and r.back == t
        forms[r.form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 10


def test_fill_in_middle_edges(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
    (r,) = fim.fill_in_middle(spark.createDataFrame([(None, "a b c")], DOCS), rate=100).collect()
    assert r.doc_id is None and r.n == 3 and r.form in ("psm", "spm")
    long = "word \n" * 1_500_000
    n, cut, end = fim.parts(long.encode(), 777_777, 5)
    assert (n, cut, end) == (1_500_001, len("word \n") * 5 - 2, len("word \n") * 777_777 - 2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranked_bits(seed):
    rng = random.Random(seed)
    mask = rng.getrandbits(rng.randrange(1, 900)) | 1
    assert [fim.place_of(mask, k + 1) for k in range(mask.bit_count())] == [i for i in range(mask.bit_length()) if mask >> i & 1]


# ---- substring dedup


def brute(docs, width=13):
    first, out = {}, []
    split = [(i, re.findall(WORD, t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    for i, w in split:
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha(kept), kept))
    return sorted(out)


def passages(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 3))) for _ in range(40)]
    common = [rng.choice(words) for _ in range(80)]
    docs = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            lo = rng.randrange(80)
            w[len(w) // 2 : len(w) // 2] = common[lo : lo + rng.randrange(5, 40)]
        t = rng.choice([" ", "\n", "\t "]).join(w)
        if docs and rng.random() < 0.3:
            t = (rng.choice(docs)[1] or "") + rng.choice(["", " x", f" {t}"])
        docs.append((i * 37 % 997, t))
    return [*docs, (1000, None), (1001, ""), (1002, "a b " * 90), (1003, "a b " * 70), (1004, "b " * 30), (1005, " ".join(common[:13])), (1006, " ".join(common[:12]))]


@pytest.mark.parametrize(("seed", "small"), [(1, {}), (2, {"SLICE": 60, "BLOCK": 64, "HOT": 2, "BUCKET": 400}), (3, {"SLICE": 150, "HOT": 1})])
def test_substring_dedup_against_brute_force(spark, seed, small, monkeypatch):
    for name, value in small.items():
        monkeypatch.setattr(sd, name, value)
    docs = passages(seed)
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], f"{DOCS}, mark int, words string").repartition(4)
    assert sorted(map(tuple, sd.substring_dedup(df).collect())) == brute(docs)


@pytest.mark.parametrize(("block", "width"), [(10**6, 13), (50, 13), (30, 7), (1, 13)])
def test_factors_cover_what_is_repeated(block, width, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", block)
    rng = random.Random(block)
    base = [rng.choice("abcdef") for _ in range(150)]
    segments = list({" ".join(base[o : o + rng.randrange(width, 40)] if rng.random() < 0.8 else [rng.choice("ab") for _ in range(20)]) for o in (rng.randrange(110) for _ in range(80))})
    doc = np.array([rng.randrange(40) for _ in segments])
    got = {(s, p + k) for s, p, n in zip(*map(np.ndarray.tolist, sd.repeated_in([s.encode() for s in segments], doc, width)), strict=True) for k in range(n)}
    first = {}
    split = [s.split() for s in segments]
    for w, d in zip(split, doc.tolist(), strict=True):
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, d), d)
    assert got == {(s, k + j) for s, w in enumerate(split) for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < doc[s] for j in range(width)}
    assert got


def test_substring_dedup_edges(spark):
    assert sd.substring_dedup(spark.createDataFrame([], DOCS)).count() == 0
    t = " ".join(f"w{k}" for k in range(20))
    got = sorted((str(r.doc_id), r.n_removed) for r in sd.substring_dedup(spark.createDataFrame([(None, t), (4, t), (7, t), (7, f"x {t}"), (7, t)], DOCS)).collect())
    assert got == [("4", 0), ("7", 20), ("7", 20), ("7", 20), ("None", 0)]
    long = " ".join(f"w{k}" for k in range(400_000))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.substring_dedup(spark.createDataFrame([(1, long), (2, f"y {long}")], DOCS)).collect()}
    assert got == {1: (400_000, 0), 2: (400_001, 400_000)}
    with pytest.raises(ValueError, match="width"):
        sd.substring_dedup(spark.createDataFrame([], DOCS), width=5)


# ---- source divergence


def audit(rows, top, min_docs=3, scale=10**9):
    counts, seen, groups = {}, {}, set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            seen.setdefault((lang, w), set()).add(k)
            counts[lang, source, w] = counts.get((lang, source, w), 0) + 1
    terms = {lang: sorted((w for (x, w), d in seen.items() if x == lang and len(d) >= min_docs), key=str.encode) for lang, _ in groups}
    own = {g: [counts.get((*g, w), 0) for w in terms[g[0]]] for g in groups}

    def p(ns):
        return [1 + scale * (n + 1) // (sum(ns) + len(ns)) for n in ns]

    out = []
    for lang, source in groups:
        a = p(own[lang, source])
        pair = [(sum((x - y) ** 2 // y for x, y in zip(a, p(own[lang, o]), strict=True)), o) for x, o in groups if x == lang and o != source]
        whole = p([sum(own[g][k] for g in groups if g[0] == lang) for k in range(len(terms[lang]))])
        term = [((x - y) ** 2 // y, w) for x, y, w, n in zip(a, whole, terms[lang], own[lang, source], strict=True) if n and x > y]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            ranked = sorted(items, key=lambda v: (-v[0], v[1].encode()))[:most]
            out += [(lang, source, part, i, v, k) for k, (v, i) in enumerate(ranked, 1)]
    return sorted(out)


def test_source_divergence(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the", "The", "öl", "日本", "x9y", "end.", "Straße", " ", "z\x7fz", *("".join(rng.choice("abc") for _ in range(3)) for _ in range(25))]
    rows = [(" ".join(rng.choice(words[: rng.randrange(2, 34)]) for _ in range(rng.randrange(30))), rng.choice(["en", "de"]), rng.choice(["s1", "s1", "s1", "s2", "ß", "z"])) for _ in range(150)]
    rows += [(None, "en", "none"), ("", "fr", "a"), ("only here", "fr", "b"), ("one one one", None, None), ("one one two", "", ""), ("a", "it", "alone")]
    df = spark.createDataFrame([(*r, 5, "q") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    assert sorted(map(tuple, sv.source_divergence(df, top=5).collect())) == audit(rows, 5)
    monkeypatch.setattr(sv, "HELD", 20)
    monkeypatch.setattr(sv, "SHARD", 10)
    monkeypatch.setattr(sv, "TEXT", 300)
    assert sorted(map(tuple, sv.source_divergence(df, top=200, min_docs=1).collect())) == audit(rows, 200, 1)
    assert sorted(map(tuple, sv.source_divergence(df, top=3, min_docs=999).collect())) == audit(rows, 3, 999)


def test_source_divergence_edges(spark):
    kinds = "text string, lang string, source string"
    assert sv.source_divergence(spark.createDataFrame([], kinds)).count() == 0
    rows = [("w " * 700_000, "en", "a"), ("w v " * 10, "en", "b"), ("v w", "en", "b")] * 2
    assert sorted(map(tuple, sv.source_divergence(spark.createDataFrame(rows, kinds)).collect())) == audit(rows, 200)
    with pytest.raises(ValueError, match="scale"):
        sv.source_divergence(spark.createDataFrame([], kinds), scale=1 << 40)
