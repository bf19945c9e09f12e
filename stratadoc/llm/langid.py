"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram binds its letters' vectors, the first rotated by
two and the second by one, by multiplication; a text bundles its trigrams' vectors by addition; a language's
prototype bundles its learning texts. A text has the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

DIMS = 1024
#: More different labels than this aren't languages; prototypes are sent to every task, so their number has a bound.
MOST_LANGUAGES = 2000
#: Trigram vectors a worker keeps.
KEPT = 40_000


class Profiles:
    """Trigrams of texts and their vectors, per worker."""

    def __init__(self):
        self.letter = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000, bool)
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((1024, DIMS), np.int8)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams of lower-case letters, words set off by one gap, and their counts; None without letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        fresh = points[~self.known[points]]
        if len(fresh):
            for c in np.unique(fresh).tolist():
                self.known[c], self.letter[c] = True, chr(c).isalpha()
        kept = np.where(self.letter[points], points, 0).astype(np.uint64)
        kept = np.concatenate([[np.uint64(0)], kept, [np.uint64(0)]])
        kept = kept[np.concatenate([[True], (kept[1:] != 0) | (kept[:-1] != 0)])]
        if len(kept) < 3:
            return None
        codes = (kept[:-2] << np.uint64(42)) | (kept[1:-1] << np.uint64(21)) | kept[2:]
        return np.unique(codes[kept[1:-1] != 0], return_counts=True)

    def of_letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([17, point]).integers(0, 2, DIMS, np.int8) * 2 - 1
        return self.letters[point]

    def rows(self, codes: list[int]) -> np.ndarray:
        """The vectors of trigrams, n x DIMS."""
        if len(self.row) + len(codes) > KEPT:
            self.row.clear()
        fresh = [c for c in dict.fromkeys(codes) if c not in self.row]
        need = len(self.row) + len(fresh)
        if need > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros((max(need, 2 * len(self.vectors)) - len(self.vectors), DIMS), np.int8)])
        for c in fresh:
            i = self.row[c] = len(self.row)
            self.vectors[i] = np.roll(self.of_letter(c >> 42), 2) * np.roll(self.of_letter(c >> 21 & 0x1FFFFF), 1) * self.of_letter(c & 0x1FFFFF)
        return self.vectors[[self.row[c] for c in codes]]


def with_role(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, text, lang, held_out): held out is a remainder of 1 of crc32(id as text) by 3; a null id is not."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held.alias("held_out"))


def prototypes(rows: DataFrame) -> DataFrame:
    """(lang, dim, value) of rows(text, lang): trigrams are counted in each task, then over all, then bundled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, total = Profiles(), defaultdict(lambda: defaultdict(int))

        def out() -> pa.RecordBatch:
            flat = [(lang, c, n) for lang, own in total.items() for c, n in own.items()]
            total.clear()
            langs, codes, counts = zip(*flat, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "code", "n"])

        for batch in slices(batches, 0, 1 << 20):
            own = defaultdict(list)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := profiles.trigrams(text):
                    own[lang].append(found)
            for lang, found in own.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([n for _, n in found])).astype(np.int64)
                mine = total[lang]
                for c, n in zip(codes.tolist(), sums.tolist(), strict=True):
                    mine[c] += n
            if sum(map(len, total.values())) > 300_000:
                yield out()
        if any(total.values()):
            yield out()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(), defaultdict(lambda: np.zeros(DIMS))
        for batch in batches:
            langs, codes, counts = (batch.column(i).to_pylist() for i in range(3))
            for i in range(0, len(codes), 8192):
                vectors = profiles.rows(codes[i : i + 8192]).astype(np.float64) * np.array(counts[i : i + 8192], np.float64)[:, None]
                part = np.array(langs[i : i + 8192])
                for lang in set(langs[i : i + 8192]):
                    sums[lang] += vectors[part == lang].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([x for x in sums for _ in range(DIMS)], pa.string()), pa.array([*range(DIMS)] * len(sums), pa.int32()), pa.array(np.concatenate([*sums.values()]))], names=["lang", "dim", "value"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(bundle, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; learnt from rows with a language that aren't held out.

    score is the cosine with the chosen prototype, negative ones as 0. Ties go to the first name. Null texts, texts
    without letters, and all texts where nothing could be learnt are 'und' with score 0. Repeated rows get equal
    answers; an empty table gives none; other columns are ignored. Predictions see the text alone.
    """
    rows = with_role(docs, id_col, text_col, lang_col)
    learnt = prototypes(rows.where("not held_out and lang is not null and text is not null"))
    by_lang = learnt.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("own")).select("lang", "own.value").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(by_lang) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MOST_LANGUAGES} different values")
    names = [r[0] for r in by_lang]
    matrix = np.array([r[1] for r in by_lang], np.float64).reshape(-1, DIMS)
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        profiles = Profiles()
        for batch in slices(batches, 1, 1 << 20):
            found = [profiles.trigrams(t) if t else None for t in batch.column(1).to_pylist()]
            pred, score = ["und"] * len(found), [0.0] * len(found)
            at = [i for i, x in enumerate(found) if x]
            if at and names:
                codes, inverse = np.unique(np.concatenate([found[i][0] for i in at]), return_inverse=True)
                ends = np.cumsum([0, *(len(found[i][0]) for i in at)])
                bundles = np.zeros((len(at), DIMS), np.float32)
                for low in range(0, len(codes), 8192):
                    counts = np.zeros((len(at), min(8192, len(codes) - low)), np.float32)
                    for k, i in enumerate(at):
                        own = inverse[ends[k] : ends[k + 1]] - low
                        inside = (own >= 0) & (own < counts.shape[1])
                        counts[k, own[inside]] = found[i][1][inside]
                    bundles += counts @ profiles.rows(codes[low : low + 8192].tolist()).astype(np.float32)
                cosines = np.round(bundles @ matrix / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9), 4)
                for k, i in enumerate(at):
                    best = int(cosines[k].argmax())
                    pred[i], score[i] = names[best], float(min(1.0, max(0.0, cosines[k, best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "held_out").mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
