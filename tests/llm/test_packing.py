import zlib

import numpy as np
from tokenizers import Tokenizer

from stratadoc.llm import packing
from stratadoc.llm.tokens import default_tokenizer

LIB = Tokenizer.from_file(default_tokenizer())


def test_hilbert_neighbours_are_adjacent():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_ids_are_the_library_s():
    letters = [chr(c) for c in range(0x3100) if chr(c).isalnum()]
    texts = [f"A{c}{m}b {c} {m}{c}" for c in letters for m in ".!)"] + ["", " ", "Merhaba Diyarbakİ. Hİ!", "don't. can't? 'tis", "x" * 300, "<|endoftext|>.a<|endoftext|>", "ab\tc.d\u00a0e.", "\u09a1\u09bc. e\u0301. É."]
    ids, sizes = packing.encoder(default_tokenizer()).encode(texts)
    own = [e.ids for e in LIB.encode_batch_fast(texts, add_special_tokens=False)]
    assert sizes.tolist() == [*map(len, own)] and ids.tolist() == [i for x in own for i in x]
    got = packing.ended(ids, sizes, 1).to_pylist()
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*x, 1] for x in own]


def checked(rows, docs, length=2048):
    ids = {d: LIB.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, totals in ((by_doc, {d: len(x) for d, x in ids.items()}), (by_seq, None)):
        for k, spans in parts.items():
            at = 0
            for start, n in sorted(spans):
                assert start == at and n > 0
                at += n
            if totals:
                assert at == totals[k]
            else:
                assert at == length or (at < length and at & (at - 1) == 0)
    assert by_doc.keys() == ids.keys()


def test_pack(spark):
    docs = [(i, f"document {i % 7} speaks of thing number {i % 3}") for i in range(40)] + [(100, None), (101, ""), (102, "long words " * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    checked(packing.digests(packing.pack(df)).collect(), docs)
    seqs = packing.sequences(packing.pack(df, length=64)).collect()
    assert sum(s.n_tokens for s in seqs) == sum(len(s.ids) // 4 for s in seqs) == sum(len(LIB.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)


def test_empty_and_clashing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, "c", 5, "x")], "doc_id long, text string, start long, ids string")
    total = {}
    for r in packing.pack(df).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {1: 6, None: 2}


def test_on_given_tables(spark):
    rows = packing.op1_packing(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    checked(rows, docs)
