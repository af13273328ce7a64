import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strataframe.llm import html_extract, packing, quality_model, sentence_pieces
from strataframe.llm.exact_dedup import exact_groups
from strataframe.llm.quality_rules import Rule, quality_rules
from strataframe.llm.token_counts import token_counts

DOCS = "doc_id long, text string"
ODD = ["", " ", "  a  b\n\n c ", "a<|endoftext|>b <|endoftext|>", "\n", "a" * 23, "x" * 3000, "ab" * 5000, "don't we'll I'M\r\n\tx", "日本語 テキスト 🙂🙂 é é  z", "foo\nbar baz", "foo \nbar", "\x1c a \x85b", "1234567 89", "ǅ ß İ ſ K", "a\x1cb \x1cc d"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiéñü,.!|#") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    return ["".join(rng.choice(words).title() + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, keep):
    rng = random.Random(2)
    texts = ["", None, "a", "a ", "A", "x" * 100, "x" * 99 + "y"] + ["hot"] * 200
    docs = [(i * 13 % 1009, rng.choice(texts)) for i in range(400)]
    got = exact_groups(spark.createDataFrame([(*d, 1, "p") for d in docs], f"{DOCS}, h int, prefix string").repartition(5), keep).collect()
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    best = max if keep == "largest" else min
    want = sorted((i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs)
    assert sorted(map(tuple, got)) == want


def test_exact_groups_edges(spark):
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0
    got = exact_groups(spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (None, "b")], DOCS)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == {(None, None, 2, True): 2, (1, 1, 3, True): 2, (None, 1, 3, False): 1}


def test_quality_rules(spark):
    texts = [*ODD, None, *random_texts(60), "the cat sat " * 40, "\n".join(["one line of words"] * 3 + ["other"]), "a b c a b c d"]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) for j in range(3) if c[tuple(w[k : k + 3])] > 1}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:50]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    strict = quality_rules(spark.createDataFrame([(1, "word " * 60)], DOCS), (Rule("mean_word_chars", 9, None),)).first()
    assert strict.failed_rules == "mean_word_chars"
    assert quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_token_counts(spark):
    path = P.path("byte_bpe_50k.json")
    texts = [*ODD, None, *random_texts(60)]
    got = {r.doc_id: r for r in token_counts(spark.createDataFrame(list(enumerate(texts)), DOCS), path, limit=100).collect()}
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, e in enumerate(want):
        assert got[i].n_tokens == len(e), texts[i]
        assert got[i].over_limit == (len(e) > 100)
        assert got[i].n_bytes == len((texts[i] or "").encode())


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    texts = [*ODD, None, *random_texts(120), "word " * 300]
    docs = list(enumerate(texts)) + [(3, texts[3])]
    rows = packing.pack(spark.createDataFrame(docs, DOCS).repartition(3), path, capacity=128, end_id=1).collect()
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i})
        assert mine == [(k, k * 128, len(ids[k * 128 : k * 128 + 128]), zlib.crc32(ids[k * 128 : k * 128 + 128].tobytes())) for k in range(-(-len(ids) // 128))]
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 128
    assert len(seqs) <= 1.03 * sum(r.length for r in rows) / 128 + 1
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_plan_covers_all_items():
    rng = random.Random(4)
    for counts in ({4096: 3, 1: 1}, {2000: 200, 1500: 120, 700: 80}, dict(Counter(rng.randrange(1, 4096) for _ in range(3000)))):
        plan = packing.plan(counts, 4096).patterns
        seen = Counter()
        for p in plan:
            assert sum(p.lengths) <= 4096
            for n in p.lengths:
                seen[n] += p.copies
        assert seen == Counter(counts)


@pytest.mark.parametrize(("counts", "sequences"), [({1365: 5000, 1366: 5000}, 3750), ({1100: 4000, 1000: 4000, 996: 4000}, 3112), ({4096: 3, 1: 1}, 4)])
def test_program_is_solved_to_its_gap(counts, sequences):
    demand = np.bincount(list(counts), list(counts.values()), 4097).astype(int)
    columns, total, bound = packing.solved(demand, 4096)
    assert total <= bound * 1.0011 and abs(sum(columns.values()) - total) < 1e-6 * total
    covered = np.zeros(4097)
    for column, share in columns.items():
        assert sum(column) <= 4096
        for n in column:
            covered[n] += share
    assert all(covered[n] >= k * (1 - 1e-6) for n, k in counts.items())
    plan = packing.plan(counts, 4096)
    assert sum(p.copies for p in plan.patterns) == sequences and plan.bound >= sequences - 2


def test_plan_is_never_above_best_fit():
    rng = np.random.default_rng(0)
    for n in (40, 300):
        counts = {int(k): int(v) for k, v in zip(rng.choice(np.arange(10, 4096), n, False), rng.integers(1, 30, n), strict=True)}
        demand = np.bincount(list(counts), list(counts.values()), 4097).astype(int)
        assert sum(p.copies for p in packing.plan(counts, 4096).patterns) <= sum(packing.best_fit(demand, 4096).values())


@pytest.mark.parametrize(("counts", "most"), [({100: 10000}, 1.03), ({k: 10000 for k in range(10, 41)}, 1.01), ({300: 20000} | {k: 3 for k in range(1, 4096, 7) if k != 300}, 1.06)])
def test_plan_repeats_lengths(counts, most):
    plan = packing.plan(counts, 4096).patterns
    seen = Counter()
    for p in plan:
        assert sum(p.lengths) <= 4096
        for n in p.lengths:
            seen[n] += p.copies
    assert seen == Counter(counts)
    assert sum(p.copies for p in plan) <= most * -(-sum(k * n for k, n in counts.items()) // 4096)


def test_plan_is_no_worse_than_best_fit():
    rng = np.random.default_rng(3)
    files = [np.minimum(pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["n_chars"])["n_chars"].to_numpy() // 4 + 1, 4096) for sf in ("sf0.01", "sf0.1")]
    for lengths in [*files, rng.integers(1, 4097, 3000), np.r_[rng.integers(200, 3000, 2000), np.full(2000, 777)], rng.choice([1365, 1366, 2000, 2731], 5000)]:
        counts = dict(Counter(lengths.tolist()))
        demand = np.zeros(4097, np.int64)
        demand[list(counts)] = list(counts.values())
        made = packing.plan(counts, 4096)
        n = sum(p.copies for p in made.patterns)
        assert made.bound <= n <= sum(packing.best_fit(demand, 4096).values())


def test_knapsack_is_exact():
    rng = np.random.default_rng(5)
    price = np.full(61, -1.0)
    sizes = rng.choice(np.arange(3, 40), 8, replace=False)
    price[sizes] = rng.random(8)
    best, last = packing.knapsack(price, 60)
    for room in range(61):
        want = max([0.0, *(price[n] + best[room - n] for n in sizes if n <= room)])
        assert abs(best[room] - want) < 1e-12 and (last[room] == 0 or price[last[room]] >= 0)


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 50)
    path = P.path("word_bpe_49k.json")
    held, library, texts = packing.WordIds(path), Tokenizer.from_file(path), random_texts(40, 9) + ODD
    for t in texts:
        assert held.encode([t, "as ever"]) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch([t, "as ever"], add_special_tokens=False)]


def test_quality_model_learns(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "mat", "dog", "ran"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "win###"]) for _ in range(60))
    docs = [(i, good() if i % 3 else bad()) for i in range(240)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(5000, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.quality_scores(spark.createDataFrame(docs, DOCS), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(docs)
    none = quality_model.quality_scores(spark.createDataFrame(docs[:3], DOCS), labels.where("false")).collect()
    assert len(none) == 3


def test_html():
    model = html_extract.trained(pages=250)
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now, cheap.</div><article><h1>A  title</h1><p>First &amp; second\n part.<p><b>Unclosed bold text that goes on for a while, as texts do.<br>More.</p></article><section id="comments"><div class="comment"><p>I like it very much, thanks.</p></div></section><footer>&copy; site 2020. All rights.</footer>'
    got = html_extract.extract([page, "", "just text &lt;b&gt;"], model)
    assert got == ["A title First & second part. Unclosed bold text that goes on for a while, as texts do. More.", "", "just text <b>"]
    nodes = html_extract.parse(page)
    is_open = html_extract.decode(nodes, np.random.default_rng(0).normal(size=len(nodes)))
    assert all(is_open[n.parent] for n, ok in zip(nodes, is_open, strict=True) if ok and n.parent >= 0)


def test_html_text_of_the_body():
    model = html_extract.trained()
    nav, foot = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>', "<footer>&copy; site 2020. All rights.</footer>"
    text = "The first sentence of a text, which is long enough. It has a second one, and <b>bold</b> words.<br>More of it follows here, as texts do."
    want = " ".join(re.sub("<[^>]*>", " ", text).split())
    pages = [f"<body>{nav}{text}{foot}", f"<body>{nav}<article><h1>A title</h1><p>{text}</p></article></div>{foot}", f"<body>{nav}<div><p>{text}</p></div></div>{text}{foot}"]
    assert html_extract.extract(pages, model) == [want, f"A title {want}", f"{want} {want}"]
    open_heads = [f"<head><title>t</title><body>{nav}<article><p>{text}</p></article>", f"<html><head><meta charset=utf-8><title>t</title><article><p>{text}</p></article>", f"<head><title>t</head><body><article><p>{text}</p></article>"]
    assert html_extract.extract(open_heads, model) == [want] * 3


def test_html_rows(spark):
    rows = [(1, "u", None, 3), (2, None, "<p>a</p>", 4), (2, None, "<p>a</p>", 4)]
    got = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [(r.page_id, r.n_chars) for r in got][0] == (1, 0) and got[1] == got[2]


def test_sentence_pieces(spark):
    path = P.path("piece_bpe_32k.model")
    texts = [*ODD, None, *random_texts(60)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = sentence_pieces.round_trips(df, path).collect()
    assert all(r.parity for r in rows) and len(rows) == len(texts)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.round_trip == (library.decode(ids) == (texts[r.doc_id] or "")), texts[r.doc_id]
    back = {r.doc_id: r.text for r in sentence_pieces.decode(sentence_pieces.encode(df, path), path).collect()}
    assert all(back[r.doc_id] == (texts[r.doc_id] or "") for r in rows if r.round_trip)
    assert sum(r.round_trip for r in rows) >= len(rows) - 1
    assert sentence_pieces.round_trips(df.where("false"), path).count() == 0


def message(*parts):
    """A protobuf message of (number, value): floats, texts, bytes and small numbers."""
    out = b""
    for number, value in parts:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += (bytes([number << 3]) if number < 16 else bytes([number << 3 & 127 | 128, number >> 4])) + bytes([value])
        else:
            data = value.encode() if isinstance(value, str) else value
            out += bytes([number << 3 | 2, *([len(data)] if len(data) < 128 else [len(data) & 127 | 128, len(data) >> 7])]) + data
    return out


def test_unigram_equals_the_library(tmp_path):
    rng = random.Random(8)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    words = {"".join(rng.choice("abc▁") if k == 0 else rng.choice("abc") for k in range(rng.randrange(1, 5))) for _ in range(60)} | set("abc▁")
    pieces += [(w, -rng.random() * 9, 1) for w in sorted(words)]
    trainer = message((3, 1), (35, 1), (40, 0))
    data = b"".join(message((1, message((1, p), (2, s), (3, k)))) for p, s, k in pieces) + message((2, trainer), (3, message((3, 1), (4, 0), (5, 1))))
    (tmp_path / "unigram.model").write_bytes(data)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    held = sentence_pieces.Codec(str(tmp_path / "unigram.model"))
    texts = ["abc abca", "a", "", " b  c ", "aé\nz", *(" ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(9)) for _ in range(40))]
    made = held.encode(texts)
    assert made == [np.array(library.encode(t), "<u4").tobytes() for t in texts]
    assert held.decodes(made, texts) == [library.decode(library.encode(t)) == t for t in texts]
