import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from stratadoc.llm import quality


def plain_model(docs):
    """docs: (lang, text). The same model with dictionaries; n-grams are (lang, characters)."""
    count = {4: Counter()}
    for lang, text in docs:
        for word in text.split():
            s = "   " + word + " "
            for i in range(3, len(s)):
                count[4][lang, s[i - 3 : i + 1]] += 1
    for m in (3, 2, 1):
        count[m] = Counter((lang, g[1:]) for lang, g in count[m + 1])
    table = {}
    for m, own in count.items():
        t = Counter(own.values())
        n = [0] + [max(1, t[k]) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.1) for k in (1, 2, 3)]
        total, off = defaultdict(float), defaultdict(float)
        for (lang, g), v in own.items():
            total[lang, g[:-1]] += v
            off[lang, g[:-1]] += d[min(v, 3)]
        table[m] = own, total, off, d

    def p(lang, g):
        low = p(lang, g[1:]) if len(g) > 1 else 1 / 4096
        own, total, off, d = table[len(g)]
        h = lang, g[:-1]
        if h not in total:
            return low
        v = own.get((lang, g), 0)
        return max(v - d[min(v, 3)], 0) / total[h] + off[h] / total[h] * low

    return p


def plain_scores(docs, p, q):
    out = {}
    for doc, lang, text in docs:
        logs, ratio = [], []
        for word in (text or "").split():
            s = "   " + word + " "
            t = [math.log(p(lang, s[i - 3 : i + 1])) for i in range(3, len(s))]
            x = [math.log(q(lang, s[i - 3 : i + 1])) for i in range(3, len(s))]
            logs += t
            ratio.append(sum(t) - sum(x))
        if logs:
            k = math.ceil(0.02 * len(ratio))
            out[doc] = math.exp(-sum(logs) / len(logs)), sum(sorted(ratio)[:k]) / k
    return out


def test_against_plain_python(spark):
    rng = random.Random(1)
    parts = ["the", "on", "er", "ing", "ha", "é", "st"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(60):
        lang, toxic = "en" if i % 3 else "fr", i % 5 == 0
        words = [word() for _ in range(rng.randint(1, 90))] + (["scum", "idiot"] if toxic else [])
        rows.append((i, lang, " ".join(words)))
        if i % 2 or toxic:
            labels.append((i, int(i % 7 > 0), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {i for i, q, t in labels if q and not t and zlib.crc32(str(i).encode()) % quality.HELD_OUT}
    bad = {i for i, q, t in labels if t}
    want = plain_scores(rows, plain_model([r[1:] for r in rows if r[0] in good]), plain_model([r[1:] for r in rows if r[0] in bad]))
    got = {r.doc_id: (r.perplexity, r.contrast) for r in quality.judged(df, lab).collect()}
    assert got.keys() == want.keys()
    for doc, (a, b) in want.items():
        assert abs(got[doc][0] - a) < quality.GRAIN * a and abs(got[doc][1] - b) < 12 * quality.GRAIN  # a word has up to 12 n-grams, in two models


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "good words here", None), (3, "good words here", None), (4, "plain text " * 20_000, "en"), (None, "no id", "xx"), (5, "日本語 text", "ja")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, perplexity int")
    lab = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (3, 1, 1), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.accepted) for r in quality.judged(df, lab).collect()]
    assert len(got) == 7 and {d for d, ok in got if not ok} >= {1, 2} and (4, True) in got
    assert quality.judged(df, lab.limit(0)).where("accepted").count() == 5
    assert quality.judged(df.limit(0), lab).count() == 0
    assert {r.doc_id for r in quality.kept(df, lab.limit(0)).collect()} == {3, 4, 5, None}


@pytest.mark.parametrize("sf,without,good,bad", [("sf0.1", None, 0.95, 0.1), ("sf0.01", None, 0.75, 0.1), ("sf0.01", "en", 0.75, 0.3)])
def test_held_out_documents(spark, sf, without, good, bad):
    """Half of the labels are held out; a language without toxic labels is judged by models over all languages.

    On the small table some twenty documents give the thresholds, and toxic ones are ten.
    """
    sf = f"/root/testdata/{sf}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    if sf.endswith("sf0.1"):  # labelled documents alone, for time
        docs = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    every = [r for r in labels.collect() if r.doc_id in lang]
    given = [r for r in every if r.doc_id % 2 and not (r.toxic and lang[r.doc_id] == without)]
    got = {r.doc_id: r.accepted for r in quality.judged(docs, spark.createDataFrame(given, labels.schema)).collect()}
    held = [r for r in every if r.doc_id % 2 == 0]
    share = lambda ids: sum(got[i] for i in ids) / len(ids)
    clean, toxic = share([r.doc_id for r in held if r.quality and not r.toxic]), share([r.doc_id for r in held if r.toxic and lang[r.doc_id] == "en"])
    assert clean > good and toxic <= bad, (clean, toxic)


def test_groups_of_blobs_and_text_ids(spark, monkeypatch):
    """Many groups give what one gives; ids may be texts."""
    rows = [(f"d{i}", "some words of a text " * (i % 5 + 1) + str(i), ("en", "fr", None)[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(5)
    lab = spark.createDataFrame([(f"d{i}", int(i % 3 > 0), int(i % 4 == 0)) for i in range(20)], "doc_id string, quality int, toxic int")
    once = sorted(map(tuple, quality.judged(df, lab).collect()))
    monkeypatch.setattr(quality, "ANSWERED", 40)
    assert sorted(map(tuple, quality.judged(df, lab).collect())) == once and len(once) == 40
    numbers = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.kept(df, numbers).count() == 40
