"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that can be near each other meet under a blocking key. There their bits are stored as planes (one
bit of 64 fingerprints in a word); a query's distances to all of them grow plane by plane in bitwise counters fed
through carry-save adders, and a word is abandoned once all of its 64 distances exceed the radius. A block yields
a spanning forest of its links, never its pairs, and components are joined by alternating star contraction.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, frugal, slices, written

#: Fingerprints compared at once, and fingerprints a tile of columns holds.
QUERIES, COLUMNS = 256, 1 << 16
#: The eight bits of each byte value.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: From two lists of fingerprints (rows of 8-byte words) the pairs (row of the first, row of the second) that may be similar.
Proposal = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bit k of the result is 1 if set in over half the rows of hashes (n x words, uint64)."""
    n, width = len(hashes), hashes.shape[1] * 8
    counts = np.zeros(width * 256, np.int64)
    step = np.arange(width, dtype=np.int64) * 256
    for i in range(0, n, 1 << 14):
        counts += np.bincount((hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, width) + step).reshape(-1), minlength=width * 256)
    ones = counts.reshape(width, 256) @ BITS
    return np.packbits((2 * ones > n).reshape(-1), bitorder="little").view(np.uint64)


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space, tab, LF, VT, FF and CR, with A-Z in lower case."""
    return text.encode().lower().split()


def shingle_fingerprint(text: str, size: int = 3) -> int:
    """64 bits of the XXH64 (seed 42) of space-joined word shingles; fewer words: all of them; none: 0."""
    words = words_of(text)
    if not words:
        return 0
    parts = [words[i:] for i in range(size)] if len(words) >= size else [[b" ".join(words)]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in map(b" ".join, zip(*parts, strict=False))], np.uint64)
    return int(majority(hashes[:, None])[0])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


class WordHashes:
    """64-bit hashes of words, memoised."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 150_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w, 7)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of `size`-word shingles (all words where there are fewer)."""
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(total)]
        total = total ^ (total >> np.uint64(32))
    return np.unique(mixed(total))


def exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """A bit for each distance in bit-sliced counters that is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            equal = equal & counters[level]
        else:
            above = above | (equal & counters[level])
            equal = equal & ~counters[level]
    return above


def add(counters: list[np.ndarray], level: int, carry: np.ndarray) -> None:
    while level < len(counters):
        counters[level], carry = counters[level] ^ carry, counters[level] & carry
        level += 1


def near(queries: np.ndarray, columns: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, column) of rows (n x words, uint64) that differ in at most radius bits."""
    width, n = columns.shape[1] * 64, len(columns)
    blocks = -(-n // 64)
    padded = np.zeros((blocks * 64, columns.shape[1]), np.uint64)
    padded[:n] = columns
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # width x blocks
    own = np.where(np.unpackbits(np.ascontiguousarray(queries).view(np.uint8), axis=1, bitorder="little").T, FULL, np.uint64(0))  # width x queries
    q, b = (x.reshape(-1) for x in np.meshgrid(np.arange(len(queries)), np.arange(blocks), indexing="ij"))
    counters = [np.zeros(len(q), np.uint64) for _ in range(width.bit_length())]
    step = 8 if radius < 8 else 64
    for start in range(0, width, step):
        for k in range(start, start + step, 2):
            x, y = own[k][q] ^ planes[k][b], own[k + 1][q] ^ planes[k + 1][b]
            low = counters[0]
            counters[0], carry = low ^ x ^ y, (low & x) | (y & (low ^ x))  # a carry-save adder: three ones' planes make a sum and a carry
            add(counters, 1, carry)
        if start + step > radius:
            live = np.flatnonzero(exceeds(counters, radius) != FULL)
            if len(live) < len(q):
                q, b, counters = q[live], b[live], [c[live] for c in counters]
            if not len(q):
                break
    hit = np.unpackbits(np.ascontiguousarray(~exceeds(counters, radius)).view(np.uint8).reshape(len(q), 8), axis=1, bitorder="little") if len(q) else np.zeros((0, 64), np.uint8)
    at, bit = np.nonzero(hit)
    i, j = q[at], b[at] * 64 + bit
    return i[j < n], j[j < n]


class Forest:
    """Union-find over the rows of a block; remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def block_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows of a block.

    In large blocks a few pivots come first: what is linked to a pivot needs no comparison among itself.
    """
    forest, rest = Forest(len(prints)), np.arange(len(prints))

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), QUERIES):
            for j in range(0, len(b), COLUMNS):
                x, y = near(prints[a[i : i + QUERIES]], prints[b[j : j + COLUMNS]], radius)
                for u, v in zip(a[i + x].tolist(), b[j + y].tolist(), strict=True):
                    if u != v:
                        forest.join(u, v)

    for _ in range(16):
        if len(rest) <= 4 * QUERIES:
            break
        linked = np.zeros(len(rest), bool)
        for j in range(0, len(rest), COLUMNS):
            linked[j + near(prints[rest[:1]], prints[rest[j : j + COLUMNS]], radius)[1]] = True
        own, rest = rest[linked], rest[~linked]
        for v in own[1:].tolist():
            forest.join(int(own[0]), v)
        compare(own, rest)
        if len(own) < QUERIES:
            break
    if len(rest) > 1:
        compare(rest, rest)
    return forest.links


def links(blocks: DataFrame, radius: int) -> DataFrame:
    """(a, b): spanning links of blocks(key, node, print), node long and print binary of 8-byte words.

    Sorted runs of a key stream by; runs of one row are dropped, short runs are compared together (a link across
    two of them is as good), and a run's memory is its fingerprints.
    """

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, prints, key, run = [], [], None, []

        def out() -> pa.RecordBatch:
            nonlocal nodes, prints
            ids, own = np.array(nodes, np.int64), np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
            nodes, prints = [], []
            ids, first = np.unique(ids, return_index=True)
            found = block_links(own[first], radius)
            pairs = ids[np.array(found, np.int64).reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

        for batch in batches:
            for k, node, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != key:
                    if len(run) > 1:
                        nodes += [x[0] for x in run]
                        prints += [x[1] for x in run]
                        if len(nodes) >= QUERIES:
                            yield out()
                    key, run = k, []
                run.append((node, own))
        if len(run) > 1:
            nodes += [x[0] for x in run]
            prints += [x[1] for x in run]
        if nodes:
            yield out()

    dealt = blocks.select("key", "node", "print").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches.

    Alternating large and small stars, in a logarithmic number of rounds; each round is a written table.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = stars.agg(F.count("*").alias("n"), mark.alias("h")).first()
    while seen.n:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "stars")
        drop_written(stars)
        stars, before = now, seen
        seen = stars.agg(F.count("*").alias("n"), mark.alias("h")).first()
        if seen == before:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): the 64-bit fingerprint of each text as 8 little-endian bytes; null and wordless texts give zero."""

    @frugal
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [shingle_fingerprint(t or "", size).to_bytes(8, "little") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["id", "print"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(make, f"id {src.schema['id'].dataType.simpleString()}, print binary").withColumnRenamed("id", id_col)


def pigeonhole_keys(radius: int = 2) -> list[tuple[int, int]]:
    """Pairs of quarters (of 2 bytes) of a 64-bit fingerprint: two differing bits leave two quarters alike."""
    if radius != 2:
        raise ValueError("quarters in pairs find distances up to 2")
    return [(i, j) for i in range(4) for j in range(i + 1, 4)]


def near_components(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; fingerprints link at 2 or fewer differing bits.

    component_id is the smallest id that a row reaches. Rows of one fingerprint are one node, so groups of copies of
    any size meet as a single row. Null and wordless texts have fingerprint zero, which links like any other. Rows
    without id link nothing and take the component of their fingerprint. An empty table gives none; other columns
    are ignored.
    """
    prints = written(fingerprints(docs, size, id_col, text_col), "prints")
    nodes = prints.groupBy("print").agg(F.min(id_col).cast("long").alias("node"))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("table"), F.substring("print", 2 * i + 1, 2).alias("x"), F.substring("print", 2 * j + 1, 2).alias("y")) for k, (i, j) in enumerate(pigeonhole_keys())]))
    blocks = nodes.where("node is not null").select(keys.alias("k"), "node", "print").select(F.concat(F.char(F.col("k.table") + 65).cast("binary"), "k.x", "k.y").alias("key"), "node", "print")
    found = components(links(blocks, 2))
    classes = nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    text = F.lower(F.concat(*[F.hex(F.substring("print", i, 1)) for i in range(8, 0, -1)]))
    return prints.join(classes, "print", "left").select(id_col, text.alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The wide form, for similarity of shingle sets: bits of a fingerprint, and blocking keys of so many least hashes each.
WIDE_BITS, KEYS, LEAST = 1024, 18, 3
#: Rows, and shingles of all rows, that one side of a comparison holds (one row at least); larger blocks are split into tiles.
TILE_ROWS, TILE_SHINGLES = 4096, 4 << 20


def wide_radius(similarity: float, bits: int = WIDE_BITS) -> int:
    """The expected distance of SimHashes of two equally large sets with this Jaccard similarity."""
    return int(round(np.arccos(2 * similarity / (1 + similarity)) / np.pi * bits))


def packed_set(hashes: np.ndarray) -> bytes:
    """Sorted hashes by their upper 40 bits, as differences, byte plane by byte plane."""
    steps = np.diff(hashes >> np.uint64(24), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    planes = np.zeros((8, len(data) // 5), np.uint8)
    planes[:5] = np.frombuffer(data, np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def block_keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS keys of LEAST least hashes each, one from each of as many equal ranges of the sorted hashes; an empty range takes the next one's."""
    n = KEYS * LEAST
    bounds = (np.arange(n, dtype=np.uint64) * np.uint64((1 << 64) // n)).astype(np.uint64)
    place = np.searchsorted(hashes, bounds)
    least = hashes[place % len(hashes)].reshape(KEYS, LEAST)  # the first at or after the range's beginning, around the end
    key = np.arange(KEYS, dtype=np.uint64)
    for k in range(LEAST):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ least[:, k])
    return key.view(np.int64)


def wide_prints(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, class, print, keys, n, shingles): class hashes the words in order; a text without words has no keys and shingles."""
    spread = seeds(WIDE_BITS // 64, 11)

    @frugal
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            classes, prints, keys, sizes, sets = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text or "")
                classes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                own = shingle_hashes(hashes.of(words), size) if words else np.zeros(0, np.uint64)
                prints.append(majority(mixed(own[:, None] ^ spread)).tobytes() if words else bytes(WIDE_BITS // 8))
                keys.append(block_keys(own).tolist() if words else [])
                sizes.append(len(own))
                sets.append(packed_set(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.binary()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["id", "class", "print", "keys", "n", "shingles"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(make, f"id {src.schema['id'].dataType.simpleString()}, class binary, print binary, keys array<long>, n long, shingles binary")


@functools.cache
def candidate_radius(similarity: float, bits: int = WIDE_BITS) -> int:
    """The distance that SimHashes of two sets with at least this Jaccard similarity exceed once in a billion times.

    Six standard errors above the largest expected distance: wide_radius for large sets, and more for some small ones,
    whose majorities are near ties; those are worked out over all sizes of union up to 64.
    """
    worst = wide_radius(similarity, bits) / bits
    for union in range(2, 65):
        common = int(np.ceil(similarity * union - 1e-9))
        chance = np.array([math.comb(common, k) for k in range(common + 1)]) / 2.0**common
        for own in range(union - common + 1):
            ones = []  # the chance of a set's bit, after how many of the common shingles have it
            for extra in (own, union - common - own):
                more = np.array([math.comb(extra, k) for k in range(extra + 1)]) / 2.0**extra
                ones.append(np.array([more[2 * (k + np.arange(extra + 1)) > common + extra].sum() for k in range(common + 1)]))
            x, y = ones
            worst = max(worst, float((chance * (x * (1 - y) + y * (1 - x))).sum()))
    return min(bits, math.ceil(bits * worst + 6 * math.sqrt(bits * worst * (1 - worst))))


class Block:
    """Rows that meet under a key, the most central first: those whose shingles most others have."""

    def __init__(self, nodes: list[int], components: list[int], prints: list[bytes], sets: list[bytes]):
        self.nodes = np.array(nodes, np.int64)
        self.label = np.unique(np.array(components, np.int64), return_inverse=True)[1]
        self.prints = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
        own = [unpacked_set(x) for x in sets]
        self.sizes = np.array([*map(len, own)], np.int64)
        _, self.flat, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flags = np.zeros(len(counts), bool)
        self.order = np.argsort(-np.add.reduceat(counts[self.flat], self.starts) / self.sizes, kind="stable")

    def common(self, row: int, others: np.ndarray) -> np.ndarray:
        """How many shingles a row has in common with each of the others."""
        own = self.flat[self.starts[row] : self.starts[row] + self.sizes[row]]
        self.flags[own] = True
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        hits = self.flags[self.flat[np.arange(ends[-1]) + np.repeat(self.starts[others] - ends + sizes, sizes)]]
        self.flags[own] = False
        return np.add.reduceat(hits, ends - sizes, dtype=np.int64)

    def links(self, propose: Proposal, similarity: float, first: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Links that join components of the block: rows at least that similar. first: which rows are one side; they meet the others alone.

        The fingerprints propose pairs of different components; the shingles decide.
        """
        rows = self.order if first is None else self.order[first[self.order]]
        others = self.order if first is None else self.order[~first[self.order]]
        for low in range(0, len(rows), QUERIES):
            if (self.label == self.label[0]).all():
                return
            own = rows[low : low + QUERIES]
            rest = others[low:] if first is None else others
            x, y = propose(self.prints[own], self.prints[rest])
            a, b = self.sizes[own[x]], self.sizes[rest[y]]
            fit = np.minimum(a, b) >= similarity * np.maximum(a, b)
            cuts = np.searchsorted(x := x[fit], np.arange(len(own) + 1)) if (np.diff(x[fit]) >= 0).all() else None
            y = y[fit]
            if cuts is None:
                by = np.argsort(x, kind="stable")
                x, y = x[by], y[by]
                cuts = np.searchsorted(x, np.arange(len(own) + 1))
            for q, row in enumerate(own.tolist()):
                found = rest[y[cuts[q] : cuts[q + 1]]]
                found = found[self.label[found] != self.label[row]]
                if not len(found):
                    continue
                both = self.common(row, found)
                for other in found[both >= similarity * (self.sizes[row] + self.sizes[found] - both) - 1e-9].tolist():
                    if self.label[other] != self.label[row]:
                        self.label[self.label == self.label[other]] = self.label[row]
                        u, v = int(self.nodes[row]), int(self.nodes[other])
                        yield min(u, v), max(u, v)


def similar_links(blocks: DataFrame, propose: Proposal, similarity: float) -> DataFrame:
    """(a, b): links of blocks(key, left, right, tile, node, component, print, shingles) that join components.

    Rows of one (key, left, right) meet; where left and right differ, those of tile left meet those of tile right. Small
    blocks are compared together, as a link across two of them is as good.
    """

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(run: list[tuple], apart: bool) -> pa.RecordBatch:
            rows = [*{(r[4], r[7]): r for r in run}.values()]  # a row of each node and text
            block = Block(*([r[k] for r in rows] for k in (4, 5, 6, 7)))
            first = np.array([r[3] == r[1] for r in rows]) if apart else None
            pairs = np.array([*block.links(propose, similarity, first)], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held, size = [], 0
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, left, right), group in itertools.groupby(rows, lambda r: r[:3]):
            run = [*group]
            if left != right:
                yield found(run, True)
                continue
            held += run
            size += sum(len(r[7]) for r in run)
            if len(held) >= QUERIES or size >= TILE_SHINGLES:
                yield found(held, False)
                held, size = [], 0
        if held:
            yield found(held, False)

    columns = ["key", "left", "right", "tile", "node", "component", "print", "shingles"]
    dealt = blocks.select(*columns).repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "tile", "node")
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row: components of documents whose sets of `size`-word shingles are at least this similar.

    Pairs are looked for where one of KEYS keys agrees, which two sets at 0.8 miss in three of a million cases; in a
    block, SimHashes within candidate_radius propose them, and the exact Jaccard similarity of the shingles decides.
    A block gives links that join components, never its pairs. The first key goes first, as its links spare the others
    most of theirs. A block of more than TILE_ROWS rows is split into tiles: each is compared in itself, and each pair
    of tiles in a task of its own if the block is then still in several components. Rows of the same words (A-Z in
    lower case) are one node, wordless and null ones too; so are rows of one id. Rows without id link nothing and take
    the component of their words. Ids are whole numbers.
    """
    radius = candidate_radius(similarity)
    classes = similar_classes(written(wide_prints(docs, size, id_col, text_col), "wide"), lambda x, y: near(x, y, radius), similarity)
    return classes.select(F.col("id").alias(id_col), "component_id")


def similar_classes(rows: DataFrame, propose: Proposal, similarity: float) -> DataFrame:
    """(id, n, component_id) of each of the rows(id, class, print, keys, n, shingles): components of links of at least this similarity.

    Rows of one class are one node, the smallest id stands for it; a node without keys links nothing. propose gives
    the pairs of two lists of prints that may be similar.
    """
    nodes = rows.groupBy("class").agg(F.min("id").cast("long").alias("node"))
    heads = rows.select("class", "id", "keys", "n").join(nodes.select("class", "node"), "class").where(F.col("id") == F.col("node"))
    keyed = heads.select("node", "n", F.posexplode("keys").alias("table", "key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("least < most")
    tiles = F.ceil(F.greatest(F.col("rows") / TILE_ROWS, F.col("shingles") / TILE_SHINGLES)).cast("int")
    members = written(keyed.select("node", "table", "key").distinct().join(several.select("key", tiles.alias("tiles")), "key"), "members")
    active = written(rows.select(F.col("id").cast("long").alias("node"), "print", "shingles").where("octet_length(shingles) > 0").join(members.select("node").distinct(), "node", "left_semi"), "active")
    edges, found = None, None
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    for tables, crossing in ((0, False), (KEYS, False), (KEYS, True)):
        own = members.where(F.col("table") <= tables)
        own = own.where("tiles > 1") if crossing else own
        own = own.withColumn("component", F.col("node")) if found is None else own.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        still = own.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
        blocks = own.join(still, "key", "left_semi").withColumn("tile", tile)
        if crossing:
            other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
            blocks = blocks.withColumn("other", other).where("other <> tile").withColumn("left", F.least("tile", "other")).withColumn("right", F.greatest("tile", "other"))
            if not blocks.take(1):
                break
        else:
            blocks = blocks.withColumn("left", F.col("tile")).withColumn("right", F.col("tile"))
        good = written(similar_links(blocks.join(active, "node"), propose, similarity).distinct(), "links")
        edges = good if edges is None else edges.unionByName(good)
        found = components(edges)
    drop_written(members, active)
    classes = nodes.join(found, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    return rows.select("id", "n", "class").join(classes, "class", "left").select("id", "n", "component_id")


def deduplicated(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest id, once if it is repeated with the same text; rows without id always stay."""
    verdicts = near_duplicates(docs, similarity, size, id_col, text_col)
    gone = verdicts.where(F.col("component_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col).distinct()
    stay = docs.join(gone.where(F.col(id_col).isNotNull()), id_col, "left_anti").select(*docs.columns)
    repeated = stay.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    if not repeated.take(1):
        return stay
    first = stay.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return stay.join(repeated, id_col, "left_anti").unionByName(first)
