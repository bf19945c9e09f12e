import random
import re
import zlib
from collections import Counter

import pytest

from stratadoc.llm import spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows, misspelt=199):
    """rows: (doc_id, text), run by run."""
    tally = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{own}:{run}".encode())
            if own is not None and h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            tally[run] += 1
    return {w: n for w, n in tally.items() if len(w) >= 6 and n >= 5}


def plain_forms(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    forms = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, words[w], len(near[w]), words.get(forms[w]))
    return out


def answers(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_forms(plain_words(rows))
    assert answers(spelling.op13_spelling(spark, SF)) == want and any(f for f, *_ in want.values())


def test_acceptor_is_minimal_and_ranks_its_words():
    acceptor = spelling.Acceptor()
    words = sorted({"".join(random.Random(k).choices("ab", k=5)) for k in range(40)})
    state = acceptor.add(words)
    languages = {}

    def language(p):
        if p not in languages:
            own = [""] if acceptor.final[p] else []
            for letter, to, before in acceptor.arcs[p]:
                assert before == len(own)
                own += [letter + w for w in language(to)]
            languages[p] = own
        return languages[p]

    assert language(state) == words
    assert len({tuple(language(p)) for p in range(len(acceptor.arcs))}) == len(acceptor.arcs)
    assert acceptor.add(words) == state and acceptor.add([]) == acceptor.state(False, [])


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_composition_equals_all_pairs(letters):
    rng = random.Random(letters)
    for size in (1, 2, 4, 7):
        shorter = sorted({"".join(rng.choices(letters, k=size)) for _ in range(60)})
        longer = sorted({"".join(rng.choices(letters, k=size + 1)) for _ in range(60)})
        replaced, inserted = spelling.one_edit_pairs(shorter, longer)
        assert sorted(map(sorted, replaced)) == [[i, j] for i in range(len(shorter)) for j in range(i + 1, len(shorter)) if one_edit(shorter[i], shorter[j])]
        assert sorted(inserted) == [(i, j) for i in range(len(shorter)) for j in range(len(longer)) if one_edit(shorter[i], longer[j])]
    assert spelling.one_edit_pairs(["aa"], []) == ([], [])


@pytest.mark.parametrize("partition_words", [1 << 14, 3])
def test_near_words(spark, monkeypatch, partition_words):
    """All pairs once in both directions, in partitions of any size."""
    monkeypatch.setattr(spelling, "PARTITION_WORDS", partition_words)
    rng = random.Random(partition_words)
    words = {"".join(rng.choices("aab", k=rng.randrange(2, 9))) for _ in range(250)} | {"éa" + "x" * k for k in range(40)} | {"yyyyyy" + c for c in "abcdefgh"}
    got = spelling.near_words(spark.createDataFrame([(w, k) for k, w in enumerate(sorted(words))], "word string, n long")).collect()
    n = {w: k for k, w in enumerate(sorted(words))}
    assert Counter((r.word, r.near, r.near_n) for r in got) == Counter((a, b, n[b]) for a in words for b in words if abs(len(a) - len(b)) < 2 and a != b and one_edit(a, b))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WINDOW", 1000)
    rows = [(1, None, "x"), (2, "", "x"), (3, "Colour colour COLOUR colour colour " * 40, "x"), (4, "colours " * 30 + "color, colors; colored", "x"), (4, "color " * 150 + "Ünder ünder " * 9, "x"), (None, "colored " * 10, "x"), (5, "colors " * 6 + "1234 ×× ÷÷÷÷÷÷÷ straße" * 5, "x"), (6, "z" * 5000 + " " + "q" * 3000, "x")] + [(k, "z" * 5000, "x") for k in range(10, 16)] + [(k, "z" * 5001, "x") for k in range(20, 26)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = answers(spelling.spelling_forms(df, misspelt=3))
    assert got == plain_forms(plain_words([r[:2] for r in rows], 3)) and len(got) > 4
    assert answers(spelling.spelling_forms(df)) == plain_forms(plain_words([r[:2] for r in rows], 1 << 40))
    assert spelling.spelling_forms(df.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    links = [(f"w{k:03}", f"w{k + 1:03}") for k in range(70)] + [("x", "w005"), ("y", "z")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {a: "z" if a == "y" else "w070" for a, _ in links}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0
