import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataframe.llm import katz


def factors(counts):
    n = np.zeros(katz.CUTOFF + 2, int)
    for c in counts:
        if c <= katz.CUTOFF + 1:
            n[c] += 1
    return katz.good_turing(n)


def brute(docs, order):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in docs}
    uni = Counter(w for i in toks if not held[i] for w in toks[i])
    total = sum(uni.values())
    d1 = factors(uni.values())
    lost = sum((1 - d1[c]) * c for c in uni.values() if c <= katz.CUTOFF)
    unseen = lost / total

    grams = defaultdict(Counter)
    for i in toks:
        if not held[i]:
            w = ["<s>"] * (order - 1) + toks[i]
            for n in range(2, order + 1):
                for k in range(order - 1, len(w)):
                    grams[(n, *w[k - n + 1 : k])][w[k]] += 1
    d = {n: factors([c for h in grams if h[0] == n for c in grams[h].values()]) for n in range(2, order + 1)}
    alphas = {}

    def p(n, h, w):
        if n == 1:
            return d1[min(uni[w], katz.CUTOFF + 1)] * uni[w] / total if uni[w] else unseen
        seen = grams.get((n, *h))
        if not seen:
            return p(n - 1, h[1:], w)
        size = sum(seen.values())
        left = sum((1 - d[n][min(c, katz.CUTOFF + 1)]) * c / size for c in seen.values())
        spare = 0 if left > 0 else 0.5 / (size + 0.5)
        if w in seen:
            return (1 - spare) * d[n][min(seen[w], katz.CUTOFF + 1)] * seen[w] / size
        if (n, h) not in alphas:
            alphas[n, h] = (left or spare) / (1 - sum(p(n - 1, h[1:], x) for x in seen))
        return alphas[n, h] * p(n - 1, h[1:], w)

    # every context's probabilities sum to one over the known words and the unknown class
    for h in list(grams)[:40]:
        assert math.isclose(sum(p(h[0], h[1:], w) for w in [*uni, "<unknown>"]), 1, abs_tol=1e-12)
    out = {}
    for i, ws in toks.items():
        w = ["<s>"] * (order - 1) + ws
        score = sum(math.log10(p(order, tuple(w[k - order + 1 : k]), w[k])) for k in range(order - 1, len(w)))
        base = sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (len(uni) + 1))) for x in ws)
        out[i] = (held[i], len(ws), sum(uni[x] > 0 for x in ws), total, base, score)
    return out


@pytest.mark.parametrize(("order", "bucket"), [(2, katz.BUCKET), (3, katz.BUCKET), (2, 40), (3, 40)])
def test_matches_brute_force(spark, order, bucket, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET", bucket)  # the small one makes contexts hot
    rng = random.Random(order)
    vocab = [f"W{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocab, [1 / (k + 1) for k in range(300)], k=rng.randrange(40)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "W1 w1 new words")]
    want = brute(docs, order)
    got = katz.katz_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), order=order).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9)
        assert math.isclose(r.score, w[5], rel_tol=1e-9)


def test_empty_and_null(spark):
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = katz.katz_scores(spark.createDataFrame([(None, "a b", 1), (None, "a b", 2)], "doc_id long, text string, block int")).collect()
    assert [(r.doc_id, r.n_tokens, r.train_tokens, r.held_out) for r in got] == [(None, 3, 6, False)] * 2
