import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratadoc.llm import tokens, words

PATH = tokens.default_tokenizer()
LIB = Tokenizer.from_file(PATH)
COUNT = tokens.PrefixCounter(PATH)


def library(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", "Hello, worlds! It's they'll", "<|endoftext|>", "x<|endoftext|>y <|startoftext|", "don't 'rest ''s", "ÉÀß 12345 ΣΑΣ İx", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語 テキスト", "a\x1cb c　d", "the|table|of|x\n\nnew\tline"])
def test_every_prefix(text):
    assert [library(text[:k]) for k in range(len(text) + 1)] == COUNT.table(text).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("thearinonTHs 'dlv12.,!é\n<|ß"), max_size=24))
def test_prefixes_of_random_text(text):
    assert [library(text[:k]) for k in range(len(text) + 1)] == COUNT.table(text).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=20))
def test_totals_of_any_text(text):
    assert COUNT.table(text)[-1] == library(text)


#: Letters whose normalised form ends in a mark.
MARKED = [chr(c) for c in range(0x250, 0x20000) if chr(c).isalpha() and not unicodedata.normalize("NFC", chr(c)).lower()[-1:].isalpha()]


def test_a_mark_after_each_letter():
    assert len(MARKED) > 50
    letters = [chr(c) for c in range(0x110000) if chr(c).isalnum()]
    texts = [f"{c}{m}" for c in letters for m in (".,;:!?)" if c < "\u0600" or c in MARKED or c == "İ" else ".")]
    for low in range(0, len(texts), 20_000):
        part = texts[low : low + 20_000]
        counts, starts, sizes = COUNT.tables(part)
        assert counts[starts + sizes].tolist() == [len(e.ids) for e in LIB.encode_batch_fast(part, add_special_tokens=False)]
    assert COUNT.table("Merhaba Diyarbakİ. Hİ!")[-1] == library("Merhaba Diyarbakİ. Hİ!")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(["İ", "ı", "ß", "×", "÷", "Σ", "\u0307", "\u0301", *MARKED, *".,;:!?) aZé<|'"]), max_size=24))
def test_totals_of_marked_letters(text):
    assert COUNT.table(text)[-1] == library(text)


def test_words_of_one_hash_or_too_long(monkeypatch):
    table = words.WordTable(np.dtype(np.int64), lambda own: (np.array([hash(w) for w in own]), np.ones(len(own), np.int64)))
    texts = ["a bb ccc " * 50, "x" * 65 + " " + "y" * 64, "", " a", "bb" * 40]
    layout = words.Layout(texts)
    assert table.of(layout)[0].tolist() == [hash(w) for t in texts for w in t.split()]
    assert layout.per_text().tolist() == [150, 152, 152, 153, 154]
    one, two = layout.hashes()
    monkeypatch.setattr(words.Layout, "hashes", lambda self: (np.full(len(self.starts), 7, np.uint64), self.sizes.astype(np.uint64)))
    table.clear()
    for _ in range(2):
        assert table.of(words.Layout(["a bb ccc bb a"]))[0].tolist() == [hash(w) for w in ("a", "bb", "ccc", "bb", "a")]
    monkeypatch.undo()
    monkeypatch.setattr(words, "ENTRIES", 16)
    table.clear()
    for part in range(20):
        texts = [" ".join(f"w{part * 7 + k}" for k in range(50))]
        assert table.of(words.Layout(texts))[0].tolist() == [hash(w) for w in texts[0].split()]


def test_decomposed_text_has_the_same_total():
    for text in ["étude", "Ångström xé", "́a", "한 x"]:
        assert COUNT.table(text)[-1] == library(text)


def test_rows(spark):
    long = "word " * 40_000
    rows = [(1, None, "c"), (2, "", "c"), (3, "Two words", None), (3, "Two words", None), (4, long, "c")]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.fit_chars) for r in tokens.token_budget(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), 2048).collect()}
    assert got == {(1, 0, 0, False, 0), (2, 0, 0, False, 0), (3, 9, 2, False, 9), (4, 200_000, 40_000, True, 2048 * 5)}
    assert tokens.token_budget(spark.createDataFrame([], "doc_id long, text string"), 5).count() == 0
    tables = tokens.prefix_tables(spark.createDataFrame([(7, "a bc")], "doc_id long, text string")).first()
    assert tables.counts == [0, 1, 1, 2, 2]
