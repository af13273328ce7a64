"""Empty tables, clashing columns, very long texts, and brute force where an operator has no SQL."""

import itertools
import math

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from strataframe.llm import html_extract, packing, quality_model, sentence_pieces
from strataframe.llm.common import Workspace, clean_up
from strataframe.llm.exact_dedup import exact_groups
from strataframe.llm.katz import katz_scores
from strataframe.llm.ngram_join import ngram_components
from strataframe.llm.quality_rules import quality_rules
from strataframe.llm.suffix_dedup import suffix_dedup
from strataframe.llm.token_counts import token_counts

DOCS = "doc_id long, text string"
CLASH = f"{DOCS}, hash long, mark long, bucket int, payload binary, h int, score double, n_tokens long, length int, words string, piece int"
BYTE, WORD, PIECE = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
OPERATORS = {
    "op1": ngram_components,
    "op2": suffix_dedup,
    "op3": lambda d: token_counts(d, BYTE),
    "op5": lambda d: katz_scores(d, order=2, folds=5, held_out=1),
    "op6": lambda d: packing.pack(d, WORD, capacity=128, end_id=1),
    "op8": exact_groups,
    "op9": lambda d: sentence_pieces.round_trips(d, PIECE),
    "op10": quality_rules,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing_and_empty_tables_give_none(spark, name):
    run = OPERATORS[name]
    rows = [(1, "a text of some words that two of them share word for word here"), (2, None), (3, ""), (4, "a text of some words that two of them share word for word here"), (4, "a text of some words that two of them share word for word here"), (7, "other")]
    plain = run(spark.createDataFrame(rows, DOCS))
    more = run(spark.createDataFrame([(*r, 5, 6, 7, b"x", 8, 0.5, 9, 10, "w", 11) for r in rows], CLASH))
    assert more.columns == plain.columns
    if name != "op6":  # which of equal pieces goes where isn't fixed
        assert sorted(map(str, more.collect())) == sorted(map(str, plain.collect()))
    else:
        key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        assert sorted(map(key, more.collect())) == sorted(map(key, plain.collect()))
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_empty_tables_of_the_learned_operators(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.quality_scores(none, labels).count() == 0
    docs = spark.createDataFrame([(1, "a b", 0.1, 2), (2, None, 0.2, 3)], f"{DOCS}, score double, label int")
    got = quality_model.quality_scores(docs, labels).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_texts(spark):
    word, line = "antidisestablishment " * 60_000, "x" * 1_500_000
    docs = spark.createDataFrame([(1, word), (2, line), (3, word)], DOCS)
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in token_counts(docs.where("doc_id < 3"), BYTE).collect()}
    assert got[1].n_tokens == len(library.encode(word, add_special_tokens=False)) and got[2].n_bytes == len(line)
    groups = {r.doc_id: r for r in exact_groups(docs).collect()}
    assert (groups[1].keep_id, groups[1].group_size, groups[2].group_size) == (3, 2, 1)
    assert {r.doc_id: r.component_id for r in ngram_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    removed = {r.doc_id: r.n_removed for r in suffix_dedup(docs).collect()}
    assert (removed[1], removed[2], removed[3]) == (0, 0, len(word))
    page = f"<body><nav><a href=/a>Home</a></nav><article><h1>Title</h1><p>{'A sentence of a long article, with words. ' * 30_000}</p></article>"
    (text,) = html_extract.main_texts(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert text.n_chars > 1_000_000 and "Home" not in text.text


def test_decoding_is_the_likeliest_consistent_choice():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        nodes = [html_extract.Node("body", -1, 0, 0, False, 0)]
        for k in range(1, n):
            nodes.append(html_extract.Node("div", int(rng.integers(0, k)), 1, 0, False, k))
        odds = rng.normal(0, 2, n)
        weight = lambda choice, odds=odds: sum(-math.log1p(math.exp(-o if c else o)) for o, c in zip(odds[1:], choice, strict=True))
        legal = [c for c in itertools.product((False, True), repeat=n - 1) if all(nodes[k].parent == 0 or c[nodes[k].parent - 1] or not c[k - 1] for k in range(1, n))]
        got = html_extract.decode(nodes, odds)
        assert got[0] and tuple(got[1:]) in legal
        assert weight(got[1:]) == pytest.approx(max(map(weight, legal)))


def test_articles_in_wrappers_with_telling_names():
    model = html_extract.trained()
    article = "<h1>A title of it</h1><p>" + "This is the article, with its words. " * 6 + "</p><p>" + "More of the article, and more words. " * 5 + "</p>"
    nav, foot = "<nav><a href=/a>Home</a> <a href=/b>News</a></nav>", "<footer>&copy; 2020 Someone</footer>"
    want = "A title of it " + ("This is the article, with its words. " * 6 + "More of the article, and more words. " * 5).strip()
    comments = '<section id="comments"><h3>Talk</h3>' + "<article class=comment><p>someone says things at length, so very long and long again and more</p></article>" * 14 + "</section>"
    pages = [
        f'<body>{nav}<div class="layout-sidebar-left">{article}</div>{foot}',
        f'<body><form id="aspnetForm">{nav}<div>{article}</div>{foot}</form>',
        f'<body>{nav}<article class="product-review">{article}</article>{foot}',
        f'<body>{nav}<div class="register-article">{article}</div>{foot}',
        f"<body>{nav}<article>{article}</article><script src=a/>var x=1;</script>{foot}",
        f"<body>{nav}<article>{article}</article>{comments}{foot}",
        f'<body>{nav}<div class="css-1x2y3z"><div class="css-9k">{article}</div></div>{foot}',
    ]
    assert html_extract.extract(pages, model) == [want] * len(pages)
    short = '<article class="product-review"><h1>Title</h1><p>A short one, but it is the article here.</p></article><div class=sidebar><h3>Other</h3><p>' + "side words that go on and on. " * 20
    assert html_extract.extract([f"<body>{nav}{short}"], model) == ["Title A short one, but it is the article here."]
    assert html_extract.extract(['<body><article><h1>T</h1><p>before it, some words.</p></article><script src="a"/><p>after'], model)[0].startswith("T before it")


def test_quality_scores_are_the_average_of_learned_odds():
    rng = np.random.default_rng(3)
    model = quality_model.Model(rng.normal(0, 3, quality_model.train([], np.zeros(0, np.int64)).odds.shape).astype(np.float32), 0.25)
    texts = ["", "one", "one two two three", "ä ß 日本 " * 9, "word " * 500]
    got = quality_model.Scorer(model).scores(texts)
    for text, p in zip(texts, got, strict=True):
        at, weight = quality_model.document_bag(text)
        z = model.bias + float((model.odds[at].astype(float) * weight).sum())
        assert p == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)


def test_workspaces_are_dropped_and_cleaned(spark, tmp_path):
    work = Workspace(spark, "edges")
    one, two = (work.write(spark.range(k), f"t{k}") for k in (3, 4))
    assert (one.count(), two.count()) == (3, 4)
    work.drop("t3")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        work.read("t3")
    assert work.read("t4").count() == 4
    clean_up(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        work.read("t4")
