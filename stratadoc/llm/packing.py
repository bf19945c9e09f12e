"""Sequence packing along a Hilbert curve through document space.

Token ids are hashed into a signed vector, a fixed random matrix projects it to few dimensions, and the cell's
place on the Hilbert curve is the sort key. A range sort by (key, id) deals the curve out over partitions - also
where a third of all documents are equal, as the id splits ties - and each partition cuts its stretch into full
sequences. What is left at its end goes into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, written
from .tokens import default_tokenizer
from .words import Layout, WordTable

DIMS, BITS, HASHED = 4, 15, 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n x dims, values below 2**bits), by Skilling's transform."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
            else:
                x[0] = np.where(high, x[0], x[0] ^ swap)
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | (((v ^ turn) >> bit) & 1)
    return key


class Encoder:
    """Ids of texts by the tokenizers library, each different word once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = max(self.lib.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.table = WordTable(self.kind, self.alone)
        suffix = getattr(self.lib.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for t, i in self.lib.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        mixed = np.arange(self.size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        self.cell = (mixed >> np.uint64(40)).astype(np.int64) % HASHED
        self.sign = np.where((mixed >> np.uint64(33)) & np.uint64(1), 1.0, -1.0)
        self.matrix = np.random.default_rng(1).standard_normal((HASHED, DIMS))

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word. Words of letters go together: each ends with its one end-of-word entry, or they go singly."""
        ids, sizes = [np.zeros(0, self.kind)] * len(words), np.zeros(len(words), np.int64)
        singly = [i for i, w in enumerate(words) if not w.isalpha()] if self.ends.any() else [*range(len(words))]
        plain = [i for i, w in enumerate(words) if w.isalpha()] if self.ends.any() else []
        flat, flat_sizes = [], []
        for low in range(0, len(plain), 4096):
            part = plain[low : low + 4096]
            own = np.array(self.lib.encode_batch_fast([" ".join([words[i] for i in part])], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[own]) + 1
            if len(stops) != len(part) or stops[-1] != len(own):
                singly += part
                continue
            sizes[part] = np.diff(stops, prepend=0)
            flat.append(own)
            flat_sizes += part
        for i, e in zip(singly, self.lib.encode_batch_fast([words[i] for i in singly], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, self.kind)
            sizes[i] = len(e.ids)
        stops = np.cumsum(sizes)
        out = np.zeros(stops[-1] if len(stops) else 0, self.kind)
        if flat_sizes:
            own = sizes[flat_sizes]
            begin = np.repeat(stops[flat_sizes] - own - np.cumsum(own) + own, own)
            out[begin + np.arange(len(begin))] = np.concatenate(flat)
        for i in singly:
            out[stops[i] - sizes[i] : stops[i]] = ids[i]
        return out, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        layout = Layout(texts)
        ids, sizes = self.table.of(layout)
        stops = np.concatenate([[0], np.cumsum(sizes)])[layout.per_text()]
        return ids, np.diff(stops, prepend=0)

    def keys(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = len(sizes)
        vectors = np.bincount(np.repeat(np.arange(n) * HASHED, sizes) + self.cell[ids], self.sign[ids], n * HASHED).reshape(n, HASHED)
        vectors /= np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-9)
        place = 1 / (1 + np.exp(-1.702 * np.round(vectors @ self.matrix, 6)))
        return hilbert_keys(np.minimum(place * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def ended(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> pa.Array:
    """A binary of ids for each text, the end id last."""
    stops = np.cumsum(sizes + 1)
    out = np.full(len(ids) + len(sizes), end_id, ids.dtype)
    own = np.ones(len(out), bool)
    own[stops - 1] = False
    out[own] = ids
    offsets = np.concatenate([[0], stops]).astype(np.int64) * ids.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, hilbert_key, doc_tokens, ids): ids binary, little-endian, 2 or 4 bytes each, the end id last."""

    @frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            ids, sizes = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.keys(ids, sizes)), pa.array(sizes + 1, pa.int64()), ended(ids, sizes, end_id)], names=["doc_id", "hilbert_key", "doc_tokens", "ids"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(encode, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, hilbert_key long, doc_tokens long, ids binary")


class Cutter:
    """Cuts a stream of documents into sequences; holds one open sequence and the rows not yet handed on."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens, key)
        self.fill = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, key: int, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            piece = ids[start : start + self.length - self.fill]
            self.open.append((doc_id, start, piece, total, key))
            self.fill += len(piece)
            start += len(piece)
            if self.fill == self.length:
                self.close()

    def close(self) -> None:
        offset = 0
        for doc_id, start, piece, total, key in self.open:
            self.rows.append((doc_id, start, len(piece), piece.astype("<u4").tobytes(), total, self.sequence, offset, key))
            offset += len(piece)
        self.open, self.fill = [], 0
        self.sequence += 1

    def finish(self) -> None:
        pieces, left = self.open, self.fill
        self.open, self.fill = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc_id, start, piece, total, key = pieces.pop(0)
                self.open.append((doc_id, start, piece[:room], total, key))
                if len(piece) > room:
                    pieces.insert(0, (doc_id, start + room, piece[room:], total, key))
                room -= min(room, len(piece))
            self.close()


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, hilbert_key long"


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in sequences: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, hilbert_key).

    ids: little-endian unsigned 32-bit. Every document ends with end_id, so null and empty texts are one token.
    Sequences hold exactly `length` tokens, but for each partition's last ones, which are powers of two. Repeated
    rows are packed as often as they come; equal keys go by id. An empty table gives no piece. Other columns are
    ignored. A document of any length is cut as it streams; one row of ids and one open sequence are in memory.
    """
    path = tokenizer or default_tokenizer()
    rows = written(encoded(docs, id_col, text_col, path, end_id), "encoded")  # range sorting samples its input, which must not encode twice
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "hilbert_key"]

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, schema = Cutter(length, TaskContext.get().partitionId() << 32), None

        def out() -> pa.RecordBatch:
            rows, cutter.rows = cutter.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=names)

        for batch in batches:
            schema = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            for doc_id, key, ids, n in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = ids.as_py()
                cutter.add(doc_id.as_py(), key.as_py(), np.frombuffer(data, f"<u{len(data) // n.as_py()}"))
                if len(cutter.rows) >= 2000:
                    yield out()
        cutter.finish()
        if cutter.rows:
            yield out()

    along = rows.select("doc_id", "hilbert_key", "ids", "doc_tokens").repartitionByRange("hilbert_key", "doc_id").sortWithinPartitions("hilbert_key", "doc_id")
    return along.mapInArrow(cut, f"doc_id {kind}, {PIECES}")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, parts): whole sequences; a group holds one sequence, so at most `length` pieces."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("sequence_id", "n_tokens", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"), F.expr("transform(parts, p -> struct(p.offset, p.doc_id, p.start, p.length))").alias("parts"))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "hilbert_key")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
