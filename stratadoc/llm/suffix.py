"""Exact substring deduplication with suffix arrays.

A byte goes if a string of `size` bytes that covers it also starts in a document with a smaller id.

1. Texts are stored in compressed blobs; whole copies of an earlier document are set aside by their digest.
2. Every window of `size` bytes has an anchor: its smallest hashed k-gram, so equal windows have equal anchors.
   Anchor hashes are dealt into buckets; those found in one document alone are dropped.
3. Each run of windows with one remaining anchor is a context of some 70 bytes. Contexts go to the shard of their
   anchor, each blob sending equal contexts once.
4. A shard builds a suffix array over its different contexts: ranks by the first eight bytes, refined by doubling where groups
   are still unsorted (Larsson and Sadakane), then common prefixes with the suffix before (Kasai's Phi order). A
   shard that is too large for one array has several, dealt by further bits of the anchors, so equal windows are in
   one of them. Only an anchor with too many contexts for one array has windows in several; their sorted windows are
   merged range by range. Windows whose smallest document lies before their own are marked.
5. Marks return to their blobs, where the marked bytes are dropped.

No step gathers the windows of a document group: what is shuffled is anchors, contexts of repeated text, and marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, release, single_rows, slices, written

SIZE, GRAM = 50, 20
BLOB = 2 << 20
#: Text bytes whose anchors one bucket holds, and context bytes of one suffix array.
BUCKET, SHARD = 256 << 20, 4 << 20
LEAST_BUCKETS = 256
#: Parts of a shard that never share a window; small ones share a suffix array that a core's cache holds.
PARTS, TOGETHER = 256, 256 << 10
STORE = "blob long, ids binary, sizes binary, digests array<binary>, n_bytes long, data binary"


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def store(docs: DataFrame, id_col: str, text_col: str, rest: Column) -> DataFrame:
    """Blobs of whole documents that have an id, some megabytes each; rest: what else to carry for each, of any type that Arrow has."""

    @frugal
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in STORE.split(", ")]
        for batch in slices(batches, 1, BLOB):
            data = [(t or "").encode() for t in batch.column(1).to_pylist()]
            whole = b"".join(data)
            row = (number, pack(np.array(batch.column(0).to_pylist(), np.int64)), pack(np.array([*map(len, data)], np.int64)), [hashlib.blake2b(d, digest_size=16).digest() for d in data], len(whole), zstandard.compress(whole, 3))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.binary()]
            carried = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column(2)]))
            yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(row, kinds, strict=True)), carried], names=[*names, "rest"])
            number += 1

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest")).where("id is not null")
    return src.mapInArrow(fill, T.StructType([*T.StructType.fromDDL(STORE).fields, T.StructField("rest", T.ArrayType(src.schema["rest"].dataType))]))


def copies(blobs: DataFrame) -> DataFrame:
    """(blob, copied): per blob the places of documents that equal one with a smaller id, as packed int32."""

    def places(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"blob": frame["blob"][:1], "copied": [pack(np.sort(frame["place"].to_numpy(np.int32)))]})

    @frugal
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, ids, digests in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([blob] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(unpack(ids, np.int64)), pa.array(digests, pa.binary())], names=["blob", "place", "id", "digest"])

    each = blobs.select("blob", "ids", "digests").mapInArrow(listed, "blob long, place int, id long, digest binary")
    first = each.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    return each.join(first, "digest").where("id > first").select("blob", "place").groupBy("blob").applyInPandas(places, "blob long, copied binary")


def gram_hashes(part: np.ndarray, gram: int) -> np.ndarray:
    """The polynomial hash of each run of `gram` bytes, from those of runs half as long."""
    base = 0x9E3779B97F4A7C15
    power, length, out, done = part.astype(np.uint64), 1, None, 0
    while True:
        if gram & length:  # the bits of gram from below, the runs put together from the left
            out = power if out is None else out[: len(power) - done] * np.uint64(pow(base, length, 1 << 64)) + power[done:]
            done += length
        if 2 * length > gram:
            return out
        power = power[:-length] * np.uint64(pow(base, length, 1 << 64)) + power[length:]
        length *= 2


class Blob:
    """A blob's bytes and documents, without those that are copies."""

    def __init__(self, row, copied: bytes | None):
        self.data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8) if row["n_bytes"] else np.zeros(0, np.uint8)
        self.ids, self.sizes = unpack(row["ids"], np.int64), unpack(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.copied = np.zeros(len(self.ids), bool)
        if copied is not None:
            self.copied[unpack(copied, np.int32)] = True

    def contexts(self, size: int, step: int = 1 << 15) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: (hash, first window, last window, document), by first window.

        A step's arrays fit into a core's cache; a run that crosses its end is two.
        """
        gram = min(GRAM, size)
        width, out = size - gram + 1, []
        for low in range(0, len(self.data), step):
            part = self.data[low : low + step + size - 1]
            n = len(part) - size + 1
            if n <= 0:
                break
            h = gram_hashes(part, gram)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
            anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            at = np.arange(low, low + n)
            a, b = np.searchsorted(self.ends, [low, low + n - 1], "right")
            here = np.diff(np.minimum(self.ends[a : b + 1], low + n), prepend=low)
            doc = np.repeat(np.arange(a, b + 1), here)
            good = np.flatnonzero(at <= np.repeat(np.where(self.copied[a : b + 1], -1, self.ends[a : b + 1] - size), here))
            if len(good):
                anchor, at, doc = anchor[good], at[good], doc[good]
                new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(at) != 1) | (np.diff(doc) != 0)])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(at)]]) - 1
                out.append((h[anchor[first]], at[first], at[last], doc[first]))
        if not out:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices data[start : start + size], one after the other."""
    if not len(starts):
        return data[:0]
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1]) + np.repeat(starts - np.concatenate([[0], ends[:-1]]), sizes)]


def with_blobs(blobs: DataFrame, *sides: DataFrame) -> DataFrame:
    """Blobs with what else is known by blob; only compressed bytes move."""
    for side in sides:
        blobs = blobs.join(side, "blob", "left")
    return blobs


def anchors(blobs: DataFrame, size: int, buckets: int) -> DataFrame:
    """(bucket, blob, n, hashes, several): the distinct anchor hashes of a blob's bucket in order, and which of them several of its documents have."""

    @frugal
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            h, _, _, doc = Blob(row, row["copied"]).contexts(size)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, h, bucket))
            h, doc, bucket = h[order], doc[order], bucket[order]
            new = np.concatenate([[True], np.diff(h) != 0]) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            if not len(first):
                continue
            last = np.concatenate([first[1:], [len(h)]]) - 1
            several, h, bucket = doc[first] != doc[last], h[first], bucket[first]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]])
            rows = [(int(bucket[a]), row["blob"], int(b - a), pack(np.diff(h[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T), pack(np.packbits(several[a:b]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "blob", "n", "hashes", "several"])

    return blobs.mapInArrow(emit, "bucket int, blob long, n long, hashes binary, several binary")


def shared(found: DataFrame) -> DataFrame:
    """(blob, bucket, keep): of the hashes of anchors(), which ones several documents have."""

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        own = [np.cumsum(unpack(x, np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1), dtype=np.uint64) for x in frame["hashes"]]
        several = [np.unpackbits(unpack(x, np.uint8))[: len(h)].astype(bool) for x, h in zip(frame["several"], own, strict=True)]
        every = np.sort(np.concatenate(own))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        keep = []
        for h, many in zip(own, several, strict=True):
            place = np.minimum(np.searchsorted(again, h), max(0, len(again) - 1))
            keep.append(pack(np.packbits(many | (again[place] == h if len(again) else False))))
        return pd.DataFrame({"blob": frame["blob"], "bucket": frame["bucket"], "keep": keep})

    return found.groupBy("bucket").applyInPandas(judge, "blob long, bucket int, keep binary")


CONTEXTS = "shard int, blob long, local boolean, at binary, ids binary, sizes binary, data binary"


def repeated_contexts(blobs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Rows of CONTEXTS: for each shard a blob's contexts with shared anchors, their parts above 24 bits of size; `local` rows hold marks (at, sizes) that need no shard."""

    @frugal
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in CONTEXTS.split(", ")]
        for row in single_rows(batches):
            blob = Blob(row, row["copied"])
            h, first, last, doc = blob.contexts(size)
            if not len(h) or not row["kept"]:
                continue
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((h, bucket))
            new = np.concatenate([[True], np.diff(h[order]) != 0])
            rank = np.empty(len(h), np.int64)
            rank[order] = np.cumsum(new) - 1  # the place of each hash in anchors()
            kept = sorted((x["bucket"], x["keep"]) for x in row["kept"])
            uniques = np.bincount(bucket[order][new], minlength=buckets)
            keep = np.concatenate([np.unpackbits(unpack(x, np.uint8))[: uniques[b]] for b, x in kept]).astype(bool)
            use = np.flatnonzero(keep[rank])
            first, last, ids, bucket = first[use], last[use], blob.ids[doc[use]], bucket[use]
            parts = (h[use] // np.uint64(buckets) % np.uint64(PARTS)).astype(np.uint32)
            sizes = last - first + size
            # equal contexts of a blob: the smallest document's go to the shard, the others are marked here
            texts = blob.data.tobytes()
            least: dict[bytes, int] = {}
            slices_ = [texts[a : a + n] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
            for text, i in zip(slices_, ids.tolist(), strict=True):
                if least.get(text, 1 << 62) > i:
                    least[text] = i
            sent = np.fromiter((least[t] == i for t, i in zip(slices_, ids.tolist(), strict=True)), bool, len(ids))
            rows = []
            if not sent.all():
                rows.append((row["blob"] % buckets, row["blob"], True, pack(first[~sent].astype(np.int32)), b"", pack(sizes[~sent].astype(np.int32)), b""))
            go = np.flatnonzero(sent)
            go = go[np.argsort(bucket[go], kind="stable")]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[go])) + 1, [len(go)]]) if len(go) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                i = go[a:b]
                rows.append((int(bucket[i[0]]), row["blob"], False, pack(first[i].astype(np.int32)), pack(ids[i]), pack(sizes[i].astype(np.uint32) | parts[i] << np.uint32(24)), zstandard.compress(b"".join([slices_[x] for x in i.tolist()]), 3)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return blobs.mapInArrow(emit, CONTEXTS)


def refined(order: np.ndarray, rank: np.ndarray, step: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of Larsson and Sadakane: suffixes sorted and ranked to some depth, to that depth plus `step`.

    Only groups that are still unsorted are sorted again, by the rank `step` further on; suffixes that aren't wanted
    at the new depth leave the order.
    """
    order = order[wanted[order]]
    group = rank[order]
    same = np.concatenate([[False], group[1:] == group[:-1]])
    open_ = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
    key = group[open_] * np.int64(len(rank) + 1) + rank[np.minimum(order[open_] + step, len(rank) - 1)]
    by = np.argsort(key)
    order[open_], key = order[open_][by], key[by]
    new = ~same
    new[open_] |= np.concatenate([[True], key[1:] != key[:-1]])
    heads = np.flatnonzero(new)
    deeper = np.zeros(len(rank), np.int64)
    deeper[order] = np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order, deeper


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte highest; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64)


def suffix_array(text: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes with at least `depth` bytes before their end (room), sorted by those bytes."""
    n = len(text)
    have = min(8, depth)
    key = words(text) >> np.uint64(8 * (8 - have))
    order = np.flatnonzero(room >= have)
    order = order[np.argsort(key[order])]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(order) else order
    rank = np.zeros(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, len(order))))
    while have < depth:
        step = min(have, depth - have)
        order, rank = refined(order, rank, step, room >= have + step)
        have += step
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many of the first `depth` bytes each suffix of the order shares with the one before it.

    Kasai's order of work: by place in the text, through each suffix's predecessor. Words of eight bytes are compared
    at once, which takes the place of carrying the last result on by one byte.
    """
    phi = np.full(len(text), -1, np.int64)
    phi[order[1:]] = order[:-1]
    at = np.flatnonzero(phi >= 0)
    before = phi[at]
    eight = words(np.concatenate([text, np.zeros(depth, np.uint8)]))
    shared_ = np.zeros(len(text), np.int64)
    live = np.arange(len(at))
    for low in range(0, depth, 8):
        if not len(live):
            break
        n = min(8, depth - low)
        differ = (eight[at[live] + low] ^ eight[before[live] + low]) >> np.uint64(8 * (8 - n))
        equal = differ == 0
        part = np.full(len(live), n, np.int64)
        if not equal.all():
            part[~equal] = n - 1 - (np.frexp(differ[~equal].astype(np.float64))[1] - 1) // 8
        shared_[at[live]] = low + part
        live = live[equal]
    out = shared_[order]
    out[:1] = 0
    return out


class Windows:
    """A sub-shard: its contexts, and the group of equal windows that each window is in."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, size: int):
        ends = np.cumsum(sizes)
        room = np.repeat(ends, sizes) - np.arange(len(data))
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.order = suffix_array(data, room, size)
        heads = np.flatnonzero(common_prefixes(data, self.order, size) < size)
        self.group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(self.order))))
        own = ids[self.owner[self.order]]
        self.least = np.minimum.reduceat(own, heads) if len(heads) else own
        self.ids, self.starts, self.data, self.size = own, self.order[heads], data, size

    def sorted_windows(self, part: slice = slice(None)) -> np.ndarray:
        """The distinct windows in order, or a part of them; bytes are raised by one, as NumPy's strings end at a zero (UTF-8 has no 255)."""
        grid = self.data[self.starts[part, None] + np.arange(self.size)] + np.uint8(1)
        return np.ascontiguousarray(grid).view(f"S{self.size}").reshape(-1)

def united(shards: list[Windows]) -> None:
    """Smallest documents of windows that several sub-shards have: a range of the sorted windows at a time, all sub-shards together."""
    sample = np.sort(np.concatenate([w.sorted_windows(slice(None, None, max(1, len(w.starts) // len(shards)))) for w in shards]))
    pivots = sample[len(shards) :: len(shards)]
    edges = [np.concatenate([[0], np.searchsorted(w.sorted_windows(), pivots), [len(w.starts)]]) for w in shards]
    for i in range(len(pivots) + 1):
        cuts = [slice(e[i], e[i + 1]) for e in edges]
        texts = np.concatenate([w.sorted_windows(c) for w, c in zip(shards, cuts, strict=True)])
        if not len(texts):
            continue
        order = np.argsort(texts, kind="stable")
        texts = texts[order]
        heads = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
        least = np.concatenate([w.least[c] for w, c in zip(shards, cuts, strict=True)])
        least[order] = np.repeat(np.minimum.reduceat(least[order], heads), np.diff(np.append(heads, len(order))))
        for w, c, own in zip(shards, cuts, np.split(least, np.cumsum([c.stop - c.start for c in cuts])[:-1]), strict=True):
            w.least[c] = own


MARKS = "blob long, at binary, sizes binary"


def sub_shards(part: np.ndarray, starts: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Ranges of contexts, which are in order of their parts, for one suffix array each; several at once are of one large part.

    starts: where each context begins, and the end of the last.
    """
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    low = 0
    for a, b in zip(edges, edges[1:]):
        if low < a and starts[b] - starts[low] > min(TOGETHER, SHARD):
            yield [(low, a)]
            low = a
        if starts[b] - starts[a] > SHARD:
            cuts = [*(a + np.flatnonzero(np.diff((starts[a:b] - starts[a]) // SHARD, prepend=-1))).tolist(), b]
            yield [*zip(cuts, cuts[1:])]
            low = b
    if low < len(part):
        yield [(low, len(part))]


def judged(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """MARKS of a shard's contexts."""
    done = frame[frame["local"]]
    rows = [*zip(done["blob"], done["at"], done["sizes"], strict=True)]
    known: dict[bytes, int] = {}
    held = []
    for row in frame[~frame["local"]].sort_values("blob").itertuples():
        data, sizes = zstandard.decompress(row.data), unpack(row.sizes, np.uint32).astype(np.int64)
        part, sizes = sizes >> 24, sizes & ((1 << 24) - 1)
        ends = np.cumsum(sizes).tolist()
        of = [known.setdefault(data[a:b], len(known)) for a, b in zip([0, *ends], ends)]
        held.append((np.array(of, np.int64), sizes, unpack(row.ids, np.int64), unpack(row.at, np.int32).astype(np.int64), np.full(len(sizes), row.blob), part))
    if not held:
        return pd.DataFrame(rows, columns=["blob", "at", "sizes"])
    of, sizes, ids, at, blob, parts = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    # equal contexts are in the suffix arrays once, for their smallest document; what later documents have of them goes whole
    part = np.empty(len(known), np.int64)
    part[of] = parts
    by = np.argsort(part, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    of, part, texts = rank[of], part[by], [*known]
    texts = [texts[i] for i in by.tolist()]
    known.clear()
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, of, ids)
    later = ids > least[of]
    own = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(own)])
    found = []
    for ranges in sub_shards(part, starts):
        shards = [Windows(np.frombuffer(b"".join(texts[a:b]), np.uint8), own[a:b], least[a:b], size) for a, b in ranges]
        if len(shards) > 1:
            united(shards)
        found += [np.sort(w.order[w.ids > w.least[w.group]]) + starts[a] for w, (a, _) in zip(shards, ranges, strict=True)]
    del texts
    gone = np.concatenate(found)
    owner = np.searchsorted(starts, gone, "right") - 1
    counts = np.bincount(owner, minlength=len(own))
    low = np.cumsum(counts) - counts
    mine = np.flatnonzero(~later)
    n = counts[of[mine]]
    hit = np.arange(n.sum()) + np.repeat(low[of[mine]] - (np.cumsum(n) - n), n)
    place, home = np.repeat(at[mine], n) + gone[hit] - starts[owner[hit]], np.repeat(blob[mine], n)
    by = np.lexsort((place, home))
    place, home = place[by], home[by]
    first = np.flatnonzero((np.diff(place, prepend=-1) > 1) | (np.diff(home, prepend=-1) != 0))
    last = np.append(first[1:], len(place))[: len(first)] - 1
    found = [(home[first], place[first], place[last] - place[first] + size), (blob[later], at[later], sizes[later])]
    for home, place, covered in found:
        for a, b in zip(edges := [*np.flatnonzero(np.diff(home, prepend=-1)), len(home)], edges[1:]):
            rows.append((int(home[a]), pack(place[a:b].astype(np.int32)), pack(covered[a:b].astype(np.int32))))
    return pd.DataFrame(rows, columns=["blob", "at", "sizes"])


def marks(contexts: DataFrame, size: int) -> DataFrame:
    """(blob, at, sizes): runs of windows (first window, bytes covered) whose string starts in an earlier document."""
    return contexts.groupBy("shard").applyInPandas(lambda frame: judged(frame, size), MARKS)


def cut_documents(docs: DataFrame, size: int, id_col: str, text_col: str, rest: Column) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256, rest) of the rows that have an id."""
    fields = [T.StructField(n, t) for n, t in (("id", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType()), ("kept_sha256", T.StringType()))]
    blobs = written(store(docs, id_col, text_col, rest), "blobs")
    total = blobs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET)
    light = ["blob", "ids", "sizes", "n_bytes", "data"]
    same = written(copies(blobs), "copies")
    keep = shared(anchors(with_blobs(blobs.select(*light), same), size, buckets))
    kept = written(keep.groupBy("blob").agg(F.collect_list(F.struct("bucket", "keep")).alias("kept")), "kept")
    release(docs.sparkSession)
    found = marks(repeated_contexts(with_blobs(blobs.select(*light), same, kept), size, buckets), size)
    gathered = found.groupBy("blob").agg(F.collect_list(F.struct("at", "sizes")).alias("marks"))

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "rest"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            carried = batch.column(batch.schema.get_field_index("rest"))
            for number, row in enumerate(single_rows([batch.drop_columns(["rest"])])):
                blob = Blob(row, row["copied"])
                edge = np.zeros(len(blob.data) + 1, np.int32)
                for mark in row["marks"] or []:
                    at, sizes = unpack(mark["at"], np.int32), unpack(mark["sizes"], np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + sizes, -1)
                gone = np.cumsum(edge[:-1]) > 0
                rows, start = [], 0
                for i, (doc, n) in enumerate(zip(blob.ids.tolist(), blob.sizes.tolist(), strict=True)):
                    own, text = gone[start : start + n], blob.data[start : start + n]
                    if blob.copied[i] and n >= size:
                        own = np.ones(n, bool)
                    rest = text[~own].tobytes()
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                    rows.append((doc, n, int(own.sum()), spans, rest, hashlib.sha256(rest).hexdigest()))
                    start += n
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), carried[number].values], names=names)

    rest_type = blobs.schema["rest"].dataType.elementType
    return with_blobs(blobs.select(*light, "rest"), same, gathered).mapInArrow(cut, T.StructType([*fields, T.StructField("rest", rest_type)]))


def removed(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row: each text's UTF-8 bytes without the removed ones.

    kept is binary: a cut may fall inside a character. Null texts are empty. Rows that share an id never judge each
    other; rows without id lose nothing and make nothing go. An empty table gives none; other columns are ignored.
    """
    each = cut_documents(docs, size, id_col, text_col, F.lit(None).cast("boolean")).drop("rest")
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    nameless = docs.where(F.col(id_col).cast("long").isNull()).select(F.lit(None).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), text.alias("kept"), F.sha2(text, 256).alias("kept_sha256"))
    return each.unionByName(nameless).withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with what is left of their texts; characters of which a part went, go whole.

    Other columns are carried as they are. A null text stays null; rows without id stay as they are. Ids are whole
    numbers.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(F.col(text_col).isNull().alias("no_text"), F.struct(*[F.col(c) for c in others] or [F.lit(None).cast("boolean").alias("none")]).alias("own"))

    @frugal
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [x.decode(errors="ignore") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), batch.column(2)], names=["id", "kept", "rest"])

    each = cut_documents(docs, size, id_col, text_col, rest).select("id", "kept", "rest")
    each = each.mapInArrow(decode, T.StructType([T.StructField("id", T.LongType()), T.StructField("kept", T.StringType()), each.schema["rest"]]))
    cols = {id_col: F.col("id").cast(docs.schema[id_col].dataType), text_col: F.when(~F.col("rest.no_text"), F.col("kept"))}
    each = each.select(*[cols[c].alias(c) if c in cols else F.col(f"rest.own.`{c}`").alias(c) for c in docs.columns])
    return each.unionByName(docs.where(F.col(id_col).cast("long").isNull()))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
