import random
import re

import pytest

from strataframe.llm.ngram_join import ngram_components


def brute(docs, words=5, percent=75):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocab) for _ in range(30)]
    docs, texts = [], []
    for i in range(160):
        if texts and rng.random() < 0.7:
            w = list(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 12, 40, 90]))]
            if rng.random() < 0.3:
                w += passage
        texts.append(w)
        docs.append((i * 7 % 1000, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    docs += [(5000, None), (5001, ""), (5002, "  \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, ngram_components(df).collect())) == brute(docs)


def test_empty_repeated_and_clashing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(none).count() == 0
    df = spark.createDataFrame([(3, "a b c d e f", 1, 2), (3, "a b c d e f", 1, 2), (1, "A b c d e f", 1, 2), (None, "a b c d e f", 1, 2)], "doc_id long, text string, head long, digest long")
    got = sorted(map(tuple, ngram_components(df).collect()), key=str)
    assert got == sorted([(3, 2, 1), (3, 2, 1), (1, 2, 1), (None, 2, 1)], key=str)


def test_id_with_several_texts(spark):
    docs = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "q r s t u v w y"), (3, "a b c d e f g h i"), (0, "q r s t u v w x"), (9, "q r s t u v w x z z z z")]
    got = {(r.doc_id, r.component_id) for r in ngram_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == {(0, 0), (1, 0), (2, 2), (3, 0), (9, 9)}
