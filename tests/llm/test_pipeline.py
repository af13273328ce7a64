import re

import corpus_pipeline as cp
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataframe.llm import quality_model
from strataframe.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_run_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == cp.COLUMNS
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert docs.select("text").where("text <> ''").distinct().count() == docs.where("text <> ''").count()
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 80, "en", "s", 400), (3, "word " * 80, "en", "s", 400), (None, "text " * 60, None, None, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for _, stage in cp.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == cp.COLUMNS
    assert {r.doc_id for r in docs.collect()} >= {1, 3, None}
    none = docs.where("false")
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, none, SF).count() == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def exact_by_loop(docs):
    first = {}
    for i, t in docs:
        first[t] = min(first.get(t, i), i)
    return {(i, t) for i, t in docs if first[t] == i}


def near_by_loop(docs):
    docs = sorted(docs)
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in docs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                one, two = sorted((find(i), find(j)))
                root[two] = one
    return {(i, t) for i, t in docs if find(i) == i}


def repeats_by_loop(docs, width=50):
    first = {}
    for i, t in docs:
        b = t.encode()
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(first.get(b[k : k + width], i), i)
    out = set()
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        if not b or sum(gone) < len(b):
            out.add((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")))
    return out


def test_each_stage_against_a_plain_loop(spark):
    """Each stage's documents, from what its predecessor kept, equal those of a loop over all of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = lambda df: {(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()}
    stages = dict(cp.STAGES)

    model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = stages["quality_classifier"](spark, docs, SF).persist()
    rows = sorted(held(docs))
    scores = quality_model.Scorer(model).scores([t for _, t in rows])
    assert held(kept) == {r for r, s in zip(rows, scores, strict=True) if s >= 0.5}
    for name, loop in (("exact_dedup", exact_by_loop), ("ngram_jaccard_join", near_by_loop), ("suffix_array_dedup", repeats_by_loop)):
        before = held(kept)
        kept = stages[name](spark, kept, SF).persist()
        assert held(kept) == loop(before), name
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = {}
    for r in stages["best_fit_packing"](spark, kept, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, t in held(kept):
        n = len(library.encode(t, add_special_tokens=False)) + 1
        assert sorted(pieces[i]) == [(k, k * 4096, min(4096, n - k * 4096)) for k in range(-(-n // 4096))]


def test_the_classifier_stage_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 80, "en", "s", 400), (3, "word " * 80, "en", "s", 400), (None, "text " * 60, None, None, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    out = cp.STAGES[0][1](spark, docs, SF)
    assert out.columns == cp.COLUMNS and out.count() <= len(rows)
    assert cp.STAGES[0][1](spark, docs.where("false"), SF).count() == 0
