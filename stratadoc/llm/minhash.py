"""Near-duplicates by b-bit MinHash.

A document's set of shingles has SLOTS minima under as many hash functions. Bands of whole minima are the keys under
which candidates meet; of every minimum only BITS low bits are kept, packed into eight-byte words. Two signatures are
compared by counting the slots whose bits all agree; as bits of different minima agree by chance, the share is corrected
for such collisions, and pairs whose estimate is within a margin of the similarity are confirmed on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .simhash import WordHashes, mixed, packed_set, seeds, shingle_hashes, similar_classes, words_of

#: Hash functions, and the bits kept of each minimum.
SLOTS, BITS = 128, 4
#: Keys of a document, of so many whole minima each: a pair at 0.8 has none in common in three cases of a million.
BANDS, ROWS = 18, 3
#: The least bit of each slot in a word.
LOWEST = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
#: Hashes taken at once, so that a block of products stays in a core's cache.
CHUNK = 512
#: A hash function is the upper half of the product with an odd number.
FACTORS = seeds(SLOTS, 23) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, 32 bits each."""
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(hashes), CHUNK):
        upper = (FACTORS[:, None] * hashes[low : low + CHUNK]).view(np.uint32)[:, 1::2]
        np.minimum(least, upper.min(1), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, packed into 64-bit words, the first slot lowest."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key of each band: its number and its minima."""
    own = least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ own[:, k])
    return key.view(np.int64)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many slots two arrays of signatures differ, row by row after broadcasting."""
    other = x ^ y
    for step in (1, 2)[: BITS.bit_length() - 1]:
        other = other | other >> np.uint64(step)
    return np.bitwise_count(other & LOWEST).sum(-1, dtype=np.int64)


def estimate(slots_differing: np.ndarray) -> np.ndarray:
    """The similarity that a number of differing slots stands for: bits of different minima agree by chance once in 2^BITS."""
    chance = 2.0**-BITS
    return (1 - slots_differing / SLOTS - chance) / (1 - chance)


def most_differing(similarity: float, errors: float = 6) -> int:
    """The differing slots that a pair of this similarity exceeds by no more than so many standard errors."""
    share = (1 - similarity) * (1 - 2.0**-BITS)
    return min(SLOTS, math.ceil(SLOTS * share + errors * math.sqrt(SLOTS * share * (1 - share))))


def may_be_similar(queries: np.ndarray, columns: np.ndarray, most: int, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, column) of signatures whose estimate allows the similarity, in the order of queries."""
    step = max(1, cells // max(1, len(columns)))
    found = [np.nonzero(differing(queries[i : i + step, None], columns[None]) <= most) for i in range(0, len(queries), step)]
    return np.concatenate([x + i * step for i, (x, _) in enumerate(found)]), np.concatenate([y for _, y in found])


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, class, print, keys, n, shingles): class hashes the words in order; a text without words has no keys and an empty set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            classes, prints, keys, sizes, sets = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text or "")
                own = shingle_hashes(hashes.of(words), size) if words else np.zeros(0, np.uint64)
                least = minima(own)
                classes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                prints.append(signature(least).tobytes())
                keys.append(band_keys(least).tolist() if words else [])
                sizes.append(len(own))
                sets.append(packed_set(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.binary()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["id", "class", "print", "keys", "n", "shingles"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(make, f"id {src.schema['id'].dataType.simpleString()}, class binary, print binary, keys array<long>, n long, shingles binary")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: components of documents whose sets of `size`-word shingles are at least this similar.

    Words are runs of characters other than ASCII white space, with A-Z in lower case; a text of fewer words has them
    all as its one shingle. component_id is the smallest id that a row reaches, kept whether that is its own. A text
    without words, or none, has an empty set and links nothing, not even its like. Rows of the same words are one node,
    so groups of copies of any size meet as one row, as do rows of one id. Rows without id link nothing; they take the
    component of their words and are never kept. Ids are whole numbers. An empty table gives none; other columns are
    ignored. Links are looked for among rows with a band in common (two sets at 0.8 have none in three cases of a
    million, at higher similarities far fewer) and lost by the estimate once in a billion; each is confirmed on full sets.
    """
    most = most_differing(similarity)
    rows = similar_classes(written(signatures(docs, size, id_col, text_col), "signatures"), lambda x, y: may_be_similar(x, y, most), similarity)
    own = F.when(F.col("n") == 0, F.col("id").cast("long")).otherwise(F.col("component_id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)
