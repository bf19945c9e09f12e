import collections
import hashlib
import random

import numpy as np
import pytest

from stratadoc.llm import crosstok

SF = "/root/testdata/sf0.001"


class Plain:
    """Token by token, with the libraries over whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = crosstok.default_tokenizers()
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [k for k in range(256) if k not in printable]
        self.byte = {chr(k): k for k in printable} | {chr(256 + i): k for i, k in enumerate(others)}

    def of(self, text):
        """(A ids, B ids, groups as pairs of lists)"""
        if not text:
            return [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        own = [bytes(self.byte[c] for c in self.a.id_to_token(k)) for k in a]
        other = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [self.b.id_to_piece(k)]]
        if not b"".join(own) == b"".join(other) == (" " + text).encode():
            return [], [], []
        groups, i, j, x, y = [], 0, 0, 0, 0
        while i < len(a):
            i0, j0 = i, j
            x, y, i, j = x + len(own[i]), y + len(other[j]), i + 1, j + 1
            while x != y:
                if x < y:
                    x, i = x + len(own[i]), i + 1
                else:
                    y, j = y + len(other[j]), j + 1
            groups.append((a[i0:i], b[j0:j]))
        return a, b, groups


def plain_scores(texts):
    plain = Plain()
    all_ = [plain.of(t) for t in texts]
    counts = collections.Counter((g[-1], h[-1]) for _, _, groups in all_ for g, h in groups)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for a, b, groups in all_:
        links = [(g[-1], h[-1]) for g, h in groups]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def rows_of(df):
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect()]


def test_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(crosstok.op12_cross_tokenizer(spark, SF))
    assert dict(got) == dict(zip([d for d, _ in docs], plain_scores([t for _, t in docs]), strict=True)) and len(got) == len(docs)


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a   b  c", "tab\tand\n line \n end", "\n", "it's we'll I'd", "naïve café œuvre ÀÉÎ", "x́ ỳ́", "日本語 と 中文字符", "😀 👩‍👩‍👧 ok", "▁ marked ▁▁ piece", "a▁b", "nul\x00byte", "\x1c \x1d a\x1e b\x1f", "\x85 \xa0 a\xa0b", "<|endoftext|> <s> </s> <unk> <0x41>", "12345 67,890.12 !!! ... ((x))", "ﬁne ﬀ Å ² ½", "​ zero ﻿ width", "ffffffffffff " * 3, "a" * 300, "¨ ͅ ¯ x", "word " * 40 + "end"]


def test_odd_texts_as_the_libraries_give_them():
    plain, aligner = Plain(), crosstok.Aligner(*crosstok.default_tokenizers())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\tabé'sß1.日😀▁-\xa0") for _ in range(rng.randrange(40))) for _ in range(2000)] + [" ".join(rng.choice(["it's", "the", "Ünder", "über", "x1", "…", "“q”", "don't", "ſ"]) for _ in range(9)) for _ in range(300)]
    assert aligner.by_chunk
    for step in (1, 7, len(texts)):
        for low in range(0, len(texts), step):
            own = texts[low : low + step]
            x = aligner.of(own)
            a, b, g = (np.split(v, s[:-1]) for v, s in ((x.a, x.a_stops), (x.b, x.b_stops), (x.a_last, x.group_stops)))
            for k, t in enumerate(own if step != 1 else own[:1]):
                want = plain.of(t)
                assert (a[k].tolist(), b[k].tolist(), len(g[k])) == (want[0], want[1], len(want[2])), repr(t)
        if step == 1:
            texts = texts[:700]


def test_merge_paths_equal_a_plain_merge():
    rng = np.random.default_rng(3)
    for n, m, span in ((0, 0, 1), (1, 1, 1), (40, 3, 60), (300, 300, 400), (500, 20, 2000), (1, 60, 80)):
        a, b = (np.unique(np.append(rng.integers(1, span + 1, k), [span] * (k > 0))) for k in (n, m))
        for piece in (1, 2, 7, 1 << 16):
            first, last, together = crosstok.overlaps(a, b, piece)
            for i, end in enumerate(a.tolist()):
                start = a[i - 1] if i else 0
                over = [j for j in range(len(b)) if b[j] > start and (b[j - 1] if j else 0) < end]
                assert (first[i], last[i], together[i]) == (over[0], over[-1], end in b)
        at = np.arange(len(a) + len(b) + 1)
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        assert crosstok.diagonal(a, b, at).tolist() == [int((order[:d] < len(a)).sum()) for d in at]


@pytest.mark.parametrize("window,groups", [(1 << 21, 1 << 17), (50, 3)])
def test_windows_and_spelling(monkeypatch, window, groups):
    monkeypatch.setattr(crosstok, "WINDOW", window)
    monkeypatch.setattr(crosstok, "MEMO", window)
    monkeypatch.setattr(crosstok, "GROUPS", groups)
    aligner, rng = crosstok.Aligner(*crosstok.default_tokenizers()), random.Random(2)
    texts = ["", *(" ".join(rng.choice(["alpha", "naïve", "日本", "x-y", "b", "  c"]) for _ in range(60)) for _ in range(6)), None, "a▁b", "end", ""]
    got = aligner.digests(aligner.of(texts))
    assert got == [s[-1] for s in plain_scores(texts)]


def test_odd_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "null id", "x"), (3, "same id", "x"), (99, "lorem ipsum " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(3)
    key = lambda x: str(x)
    assert sorted(rows_of(crosstok.link_scores(df)), key=key) == sorted(zip([r[0] for r in rows], plain_scores([r[1] for r in rows]), strict=True), key=key)
    assert crosstok.link_scores(df.limit(0)).count() == 0
    plain = Plain()
    for r in crosstok.aligned(df.where("doc_id < 90")).join(df, "doc_id").where("doc_id <> 3").collect():
        a, b, groups = plain.of(r.text)
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [(r.a_ids[i:j], r.b_ids[k:l]) for i, j, k, l in zip([0, *r.a_stops], r.a_stops, [0, *r.b_stops], r.b_stops)] == groups
