"""Alignment of two tokenizers' tokens by merge paths, and how often tokens of both end together.

Both tokenizers cut one string of bytes. Each gives an ascending list of ends; a merge of the two lists shows which
tokens overlap, and where an end of each is the same a group closes. The merge is divided along diagonals: a binary
search finds how many of each list lie among the first d of both, for every d-th place, so pieces of equal work are
merged on their own and stitched where a group runs across a border.

Texts are encoded by chunks of a space and what follows up to the next one. Neither tokenizer has a token across such
a place, so a chunk's ids don't depend on its neighbours and are worked out once for each different chunk.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import single_rows, slices, written
from .tokens import byte_symbols
from .words import gather

#: Ends of both tokenizers in a piece of the merge, and groups spelled out at once.
PIECE, GROUPS = 1 << 16, 1 << 17
#: Characters of texts split into chunks at once; the memo of chunks is emptied when it holds so many.
WINDOW, MEMO = 1 << 21, 1 << 22
#: A single space between letters, digits or marks that are no white space and stay apart from a space in every normal form.
BETWEEN = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
PIECE_SPACE = "▁"
MASK = (1 << 32) - 1


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Strings:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([*map(len, strings)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[which], self.sizes[which])


def diagonal(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of a lie among the first `at` of both ascending lists merged, those of a first where equal."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        more = a[mid] <= b[at[open_] - mid - 1]
        low[open_[more]] = mid[more] + 1
        high[open_[~more]] = mid[~more]
    return low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the ends a, the first and the last of b's tokens that it overlaps, and whether it ends with the last."""
    last, together = np.empty(len(a), np.int64), np.empty(len(a), bool)
    cuts = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    i = diagonal(a, b, cuts)
    j = cuts - i
    for a0, a1, b0, b1 in zip(i, i[1:], j, j[1:], strict=False):
        own, other = a[a0:a1], b[b0:b1]
        at = np.searchsorted(other, own)  # the piece's size where the end lies in the next piece
        last[a0:a1] = b0 + at
        together[a0:a1] = np.append(other, -1)[at] == own
        if a1 > a0 and b1 < len(b) and own[-1] == b[b1]:  # a's end closes this piece, its equal opens the next
            together[a1 - 1] = True
    return np.concatenate([[0], last[:-1] + together[:-1]])[: len(a)], last, together


@dataclass
class Aligned:
    """Tokens of several texts one after the other. stops: of tokens and groups, per text; groups: of each token."""

    a: np.ndarray
    b: np.ndarray
    a_stops: np.ndarray
    b_stops: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_stops: np.ndarray
    a_last: np.ndarray  # the last token of each group
    b_last: np.ndarray


class Aligner:
    """Encodes and aligns texts with a byte-level BPE (A) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {s: k for k, s in enumerate(byte_symbols())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            entries[k] = bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.a_bytes = Strings(entries)
        self.b_bytes = Strings([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(PIECE_SPACE, " ").encode() for k, p in enumerate(pieces)])
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec.get("pre_tokenizer") or {}
        self.by_chunk = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not spec.get("normalizer") and not any(PIECE_SPACE in p.lstrip(PIECE_SPACE) for p in pieces)
        self.decimal = Strings([b"%d " % k for k in range(max(len(entries), len(pieces)))])
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.chars = 0
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks, each taken with a space before it."""
        got = ([], [])
        for low in range(0, len(chunks), 8192):
            own = chunks[low : low + 8192]
            got[0].extend(e.ids for e in self.a.encode_batch_fast([" " + c for c in own], add_special_tokens=False))
            got[1].extend(self.b.encode(own, num_threads=1))
        for k in (0, 1):
            self.ids[k] = np.concatenate([self.ids[k], np.fromiter(itertools.chain.from_iterable(got[k]), np.int64)])
            self.sizes[k] = np.concatenate([self.sizes[k], np.array([*map(len, got[k])], np.int64)])
        self.places.update(zip(chunks, range(len(self.places), len(self.places) + len(chunks)), strict=True))
        self.chars += sum(map(len, chunks))

    def windows(self, text: str) -> Iterator[str]:
        start = 0
        while self.by_chunk and len(text) - start > WINDOW and (cut := BETWEEN.search(text, start + WINDOW)):
            yield text[start : cut.start()]
            start = cut.end()
        yield text[start:] if start else text

    def encoded(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For A and for B the ids of all texts and how many each has. No text is empty."""
        ids, counts = ([], []), (np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64))
        parts = ((k, w) for k, t in enumerate(texts) for w in self.windows(t))
        while held := self.some(parts):
            if self.chars > MEMO:
                self.clear()
            split = [BETWEEN.split(w) if self.by_chunk else [w] for _, w in held]
            flat = [*itertools.chain.from_iterable(split)]
            self.learn([*set(flat).difference(self.places)])
            where = np.fromiter(map(self.places.__getitem__, flat), np.int64, len(flat))
            owner = np.repeat([k for k, _ in held], [*map(len, split)])
            for k in (0, 1):
                sizes = self.sizes[k][where]
                ids[k].append(gather(self.ids[k], (np.cumsum(self.sizes[k]) - self.sizes[k])[where], sizes))
                counts[k][:] += np.bincount(owner, sizes, len(texts)).astype(np.int64)
        return tuple((np.concatenate([np.zeros(0, np.int64), *ids[k]]), counts[k]) for k in (0, 1))

    @staticmethod
    def some(parts: Iterator[tuple[int, str]]) -> list[tuple[int, str]]:
        held, size = [], 0
        for k, w in parts:
            held.append((k, w))
            size += len(w)
            if size >= WINDOW:
                break
        return held

    def of(self, texts: list[str | None]) -> Aligned:
        """Texts that are null or empty, or that either tokenizer doesn't give back byte for byte, have no tokens."""
        full = [k for k, t in enumerate(texts) if t]
        (a, a_counts), (b, b_counts) = self.encoded([texts[k] for k in full])
        source = np.frombuffer("".join(" " + texts[k] for k in full).encode(), np.uint8)
        same = np.array_equal(source, self.a_bytes.joined(a)) and np.array_equal(source, self.b_bytes.joined(b))
        if not same:
            a_stops, b_stops, good = np.cumsum(a_counts), np.cumsum(b_counts), np.zeros(len(full), bool)
            for k, at in enumerate(full):
                own = np.frombuffer((" " + texts[at]).encode(), np.uint8)
                good[k] = all(np.array_equal(own, strings.joined(ids[stops[k] - counts[k] : stops[k]])) for strings, ids, stops, counts in ((self.a_bytes, a, a_stops, a_counts), (self.b_bytes, b, b_stops, b_counts)))
            a, b = a[np.repeat(good, a_counts)], b[np.repeat(good, b_counts)]
            a_counts, b_counts = a_counts * good, b_counts * good
        a_all, b_all = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        a_all[full], b_all[full] = a_counts, b_counts
        _, last, together = overlaps(np.cumsum(self.a_bytes.sizes[a]), np.cumsum(self.b_bytes.sizes[b]))
        a_last = np.flatnonzero(together)
        b_last = last[a_last]
        a_stops = np.cumsum(a_all)
        return Aligned(a, b, a_stops, np.cumsum(b_all), np.searchsorted(a_last, np.arange(len(a))), np.searchsorted(b_last, np.arange(len(b))), np.searchsorted(a_last, a_stops), a_last, b_last)

    def digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each text's groups, `a1,a2|b1;a3|b2`; empty without tokens."""
        out, stops, text, digest = [], x.group_stops.tolist(), 0, hashlib.sha256()
        for low in range(0, len(x.a_last), GROUPS):
            high = min(low + GROUPS, len(x.a_last))
            data, ends = self.spelled(x, low, high)
            at = low
            while at < high:
                while stops[text] <= at:
                    out.append("")
                    text += 1
                stop = min(stops[text], high)
                begin, end = int(ends[at - low - 1]) if at > low else 0, int(ends[stop - low - 1])
                done = stop == stops[text]
                digest.update(data[begin : end - done])
                if done:
                    out.append(digest.hexdigest())
                    text, digest = text + 1, hashlib.sha256()
                at = stop
        return out + [""] * (len(stops) - len(out))

    def spelled(self, x: Aligned, low: int, high: int) -> tuple[memoryview, np.ndarray]:
        """The groups low to high, a mark after each token, and where each group ends."""
        a0, b0 = (int(v[low - 1]) + 1 if low else 0 for v in (x.a_last, x.b_last))
        a_stop, b_stop = x.a_last[low:high] + 1 - a0, x.b_last[low:high] + 1 - b0
        a, b = x.a[a0 : a0 + a_stop[-1]], x.b[b0 : b0 + b_stop[-1]]
        group = x.b_group[b0 : b0 + len(b)] - low
        at_b = np.arange(len(b)) + a_stop[group]
        at_a = np.ones(len(a) + len(b), bool)
        at_a[at_b] = False
        ids, mark = np.empty(len(at_a), np.int64), np.full(len(at_a), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[np.flatnonzero(at_a)[a_stop - 1]] = ord("|")
        ends_b = at_b[b_stop - 1]
        mark[ends_b] = ord(";")
        data, ends = self.decimal.joined(ids), np.cumsum(self.decimal.sizes[ids])
        data[ends - 1] = mark
        return memoryview(data), ends[ends_b]


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """(id, a_ids, b_ids, a_stops, b_stops): each text's tokens and, group by group, how many tokens of A and of B it has so far.

    Texts that are null or empty, or that one of the tokenizers doesn't give back byte for byte, have empty lists.
    An empty table gives none; other columns are ignored; ids may repeat or be null.
    """
    paths = tokenizers or default_tokenizers()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        for batch in slices(batches):
            x = aligner.of(batch.column(1).to_pylist())
            lists = []
            for values, stops in ((x.a, x.a_stops), (x.b, x.b_stops), (x.a_last + 1, x.group_stops), (x.b_last + 1, x.group_stops)):
                offsets = np.concatenate([[0], stops])
                if values is not x.a and values is not x.b:
                    before = np.concatenate([[0], (x.a_stops if not len(lists) % 2 else x.b_stops)[:-1]])
                    values = values - np.repeat(before, np.diff(offsets))
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "a_ids", "b_ids", "a_stops", "b_stops"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_stops", "b_stops"))
    return src.mapInArrow(make, f"id {src.schema['id'].dataType.simpleString()}, {lists}").withColumnRenamed("id", id_col)


def blocks(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str]) -> DataFrame:
    """A row for every few megabytes of texts: their counts and digests, the different pairs of ids that end together and how often, and per text which of the pairs it has, how often."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(*paths), TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            x = aligner.of(batch.column(1).to_pylist())
            pairs, which, counts = np.unique(x.a[x.a_last] << 32 | x.b[x.b_last], return_inverse=True, return_counts=True)
            text = np.repeat(np.arange(batch.num_rows), np.diff(x.group_stops, prepend=0))
            entries, times = np.unique(text * max(1, len(pairs)) + which, return_counts=True)
            stops = np.searchsorted(entries, np.arange(1, batch.num_rows + 1) * max(1, len(pairs)))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [
                pa.array([block], pa.int64()), one(batch.column(0)),
                *(one(pa.array(np.diff(v, prepend=0), pa.int64())) for v in (x.a_stops, x.b_stops, x.group_stops)),
                one(pa.array(aligner.digests(x), pa.string())), one(pa.array(pairs, pa.int64())), one(pa.array(counts, pa.int64())),
                one(pa.array(stops, pa.int64())), pa.array([(entries % max(1, len(pairs))).astype(np.uint32).tobytes()], pa.binary()), pa.array([times.astype(np.uint32).tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "n_a", "n_b", "n_groups", "digests", "pairs", "counts", "stops", "entries", "times"])
            block += 1

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups"))
    return src.mapInArrow(make, f"block long, ids array<{kind}>, {longs}, digests array<string>, pairs array<long>, counts array<long>, stops array<long>, entries binary, times binary")


def pair_counts(own: DataFrame) -> DataFrame:
    """(pair, total, best) of blocks(): how often two ids end together, A's id in the upper 32 bits, and whether none of the B id's pairs does so more often."""
    tally = own.select(F.inline(F.arrays_zip("pairs", "counts"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total"))
    tally = written(tally.withColumn("b", F.col("pair").bitwiseAND(MASK)), "tally")
    most = tally.groupBy("b").agg(F.max("total").alias("most"))
    return tally.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def link_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """Per row its numbers of tokens, groups and links (tokens of both that end together), how many links have the highest count of their B id, the links' counts, and the digest of its groups.

    Counts are over all rows, repeated ones too. A row's links are looked up with those of its block of some megabytes,
    so each different pair of a block is asked for once. Texts that are null or empty, or that a tokenizer doesn't give
    back byte for byte, have zeros and an empty digest. An empty table gives none; other columns are ignored; ids may
    repeat or be null.
    """
    own = written(blocks(docs, id_col, text_col, tokenizers or default_tokenizers()), "blocks")
    wanted = own.select("block", F.posexplode("pairs").alias("pos", "pair")).join(pair_counts(own), "pair")
    packed = F.struct("pos", (F.col("total") * 2 + F.col("best").cast("long")).alias("v"))
    answers = wanted.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(packed)), lambda x: x.v).alias("answers"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            answer = np.array(row["answers"] or [], np.int64)
            which, times = np.frombuffer(row["entries"], np.uint32), np.frombuffer(row["times"], np.uint32).astype(np.int64)
            per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.array(row["stops"], np.int64)], prepend=0)
            sums, best = per_text(times * (answer[which] >> 1)), per_text(times * (answer[which] & 1))
            columns = [pa.array(row["ids"], kind), *(pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_groups")), pa.array(best), pa.array(sums), pa.array(row["digests"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    of_ids = own.schema["ids"].dataType.elementType
    kind = to_arrow_type(of_ids)
    longs = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    lists = own.select("block", "ids", "n_a", "n_b", "n_groups", "digests", "stops", "entries", "times").join(answers, "block", "left").drop("block")
    return lists.mapInArrow(score, f"id {of_ids.simpleString()}, {longs}, groups_sha256 string").withColumnRenamed("id", id_col)


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_scores(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
