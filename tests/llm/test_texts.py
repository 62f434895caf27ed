import os
import random
import re

import pytest

from lodeworks.llm import leaks, splitting, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="the vocabulary is not here")
ODD = [
    None, "", " ", "\n\n", "a", "it's we'll x's '''s", "Straße  naïve — “quoted” … 1,234.5", "日本語の文章。次の文です。" * 5, "emoji 👩‍👩‍👧 and flags 🇩🇪", "tab\tnbsp zero​width　wide line\x85next\x1cfs",
    "<|endoftext|> is text", "x" * 5000, "é" * 300, "a\r\nb\rc", "   lead", "trail   ", "ع" * 40 + " سلام", "0" * 700,
]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.vocabulary())


@pytest.fixture
def docs(spark):
    rnd = random.Random(1)
    texts = ODD + [" ".join(rnd.choice(["the", "of", "reactor", f"n{rnd.randrange(999)}", "Ω"]) for _ in range(rnd.randrange(80))) for _ in range(60)]
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")


def test_ids_equal_the_encoder_with_any_dictionary(spark, docs, enc, monkeypatch):
    texts, df = docs
    for head in (0, 3, tokens.HEAD_WORDS):
        monkeypatch.setattr(tokens, "HEAD_WORDS", head)
        got = {r.doc_id: r.ids for r in tokens.encoded(df, "doc_id", "text").collect()}
        assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_ids_equal_the_other_library(docs, enc):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokens.VOCABULARY.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no such file")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    for t in docs[0]:
        assert other.encode(t or "", add_special_tokens=False).ids == enc.encode_ordinary(t or "")


def test_round_trip(spark, docs):
    texts, df = docs
    coded = tokens.encoded(df, "doc_id", "text")
    assert {r.doc_id: r.text for r in tokens.decoded(coded, "doc_id").collect()} == {i: t or "" for i, t in enumerate(texts)}
    none = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert {r.k: r.text for r in tokens.decoded(none, "k").collect()} == {1: None, 2: ""}


def test_no_documents_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.encoded(empty, "doc_id", "text").count() == 0
    assert leaks.leaked_spans(empty, spark.createDataFrame([(1, "a")], "i bigint, t string"), "doc_id", "text", "i", "t").count() == 0
    assert splitting.split_oversized(empty, "doc_id", "text").count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    assert tokens.encoded(nulls, "doc_id", "text").count() == 0


# leaks


def brute(docs, items, run):
    words = lambda s: [w.casefold() for w in re.findall(r"[^\W_]+", s)]
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t or "")] for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ())}


@pytest.mark.parametrize("block", [10, 16_000_000])
def test_leaks_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "ITEM_CHARS", block)
    rnd = random.Random(block)
    text = lambda n: "".join(rnd.choice(["Ab", "c1", "é", "Straße", "x"]) + rnd.choice([" ", ", ", "_", "\n", "--"]) for _ in range(n))
    items = [(i, text(rnd.randrange(12))) for i in range(25)] + [(99, None), (98, "")]
    docs = [(i, text(40)) for i in range(40)] + [(100, None), (101, ""), (102, items[3][1].upper()), (103, items[3][1].upper())]
    d, t = spark.createDataFrame(docs, "doc bigint, item string"), spark.createDataFrame(items, "id bigint, text string")
    args = (d, t, "doc", "item", "id", "text")
    got = leaks.leaked_items(*args, run=5).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(docs, items, 5)
    by = dict(docs)
    words = lambda s: [w.casefold() for w in re.findall(r"[^\W_]+", s)]
    for r in leaks.leaked_spans(*args, run=5).collect():
        w, v = words(by[r.doc][r.start_char : r.end_char]), words(dict(items)[r.item])
        assert len(w) == r.words >= 5 and all(any(v[j : j + 5] == w[k : k + 5] for j in range(len(v))) for k in range(len(w) - 4))


@pytest.mark.parametrize("run", [1, 2, 5, 6])
def test_stretches_against_brute_force(run):
    """Repeated words, shared passages and items that overlap themselves, in every length of run."""
    rnd = random.Random(run)
    for _ in range(300):
        text = lambda n: " ".join(rnd.choice("abc"[: rnd.choice([2, 3])]) for _ in range(n))
        items = [(i, text(rnd.randrange(14))) for i in range(4)]
        doc = text(rnd.randrange(30))
        m = leaks.built(items, run)
        found = leaks.spans(doc, m) if m.automaton else []
        assert {(0, i) for i, *_ in found} == brute([(0, doc)], items, run)
        ends = {}
        words = lambda s: s.split()
        for i, t in items:
            grams = {tuple(words(t)[k : k + run]) for k in range(len(words(t)) - run + 1)}
            ends[i] = {k + run - 1 for k in range(len(words(doc)) - run + 1) if tuple(words(doc)[k : k + run]) in grams}
        for i in ends:
            assert ends[i] == {k for j, a, b, n in found if j == i for k in range(doc[:a].count(" ") + run - 1, doc[:a].count(" ") + n)}


def test_more_distinct_words_than_one_alphabet_takes(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_WORDS", 50)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(12)]
    docs = [(i, f"before {t} after") for i, t in items]
    d, t = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(items, "id bigint, text string")
    assert sorted(tuple(r) for r in leaks.leaked_items(d, t, "doc", "text", "id", "text").collect()) == [(i, i) for i in range(12)]


def test_letters_leave_out_surrogates():
    assert [ord(leaks.letter(i)) for i in (0, 0xD7FE, 0xD7FF)] == [1, 0xD7FF, 0xE000]


# splitting


def check(enc, text, limit, overlap):
    import numpy as np

    ranks = tokens.vocabulary()
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for p, i in ranks.items():
        sizes[i] = len(p)
    out = splitting.pieces_of(text, enc, sizes, limit, overlap)
    n = len(enc.encode_ordinary(text))
    assert (out == []) == (n <= limit)
    if out:
        assert "".join(text[b:e] for _, b, e, _ in out) == text
        assert all(k == len(enc.encode_ordinary(text[s:e])) <= limit for s, _, e, k in out)
        assert all(s <= b < e for s, b, e, _ in out) and out[0][0] == 0
        assert all(len(enc.encode_ordinary(text[s:b])) <= overlap + 1 and s >= p for (s, b, _, _), (p, *_) in zip(out[1:], out))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pieces_of_random_texts(enc, seed):
    rnd = random.Random(seed)
    parts = ["# Head\n\n", "## Sub\n", "- item one\n", "A sentence here. ", "another, with clause; ", "\n\n", "\r\n", "日本語の文章です。", "word ", "x" * 90, "👩‍👧", "<p>para</p>", "1) listed\n", "é", "   "]
    for limit, overlap in ((16, 4), (40, 0), (64, 16)):
        check(enc, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 250))), limit, overlap)


def test_cuts_at_the_coarsest_boundary(enc):
    section = lambda i: f"# Part {i}\n\n" + "\n\n".join("Some words of text. " * 4 for _ in range(3)) + "\n\n"
    text = "".join(section(i) for i in range(6))
    size = len(enc.encode_ordinary(section(0)))
    out = check(enc, text, 2 * size + 8, 4)
    assert all(text[b:].startswith("# Part") for _, b, _, _ in out)
    out = check(enc, text, size - 10, 4)
    assert all(text[:b].endswith("\n\n") or text[b:].startswith("# ") for _, b, _, _ in out[1:])


def test_a_text_without_boundaries_is_cut_between_characters(enc):
    for text in ("x9" * 4000, "語" * 3000, "👩‍👧" * 500):
        assert len(check(enc, text, 100, 10)) > 5


def test_pieces_table(spark, enc):
    long = "Line of words here.\n" * 400
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, ""), (5, long), (None, long)], "doc_id bigint, text string")
    rows = splitting.split_oversized(df, "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {1, 5}
    one = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.piece for r in one] == list(range(one[0].pieces)) and all(r.text == long[r.start_char : r.end_char] and r.n_tokens <= 1024 for r in one)
