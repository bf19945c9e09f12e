"""Benchmark decontamination by latent semantic retrieval.

Document frequencies are counted over all documents, for words hashed into 2**16 features. A randomised SVD
of the benchmark passages' TF-IDF rows gives the latent space; windows of every document are projected into it and
compared with the passages by cosine; long passages are indexed in chunks, and windows are as wide as chunks are
long. Pairs above a gate that follows the check's own share are checked by the longest common subsequence of
words, and by the passage's answer words where the wording differs much.

The benchmark is the stated side: it is cut into blocks of bounded size, and each block meets all documents where
they lie. Only frequencies, partial sums of the SVD and found pairs leave a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, written
from .words import Layout, WordTable

FEATURES, RANK = 1 << 16, 256
#: Words of the widest window, and from one of them to the next; shorter passages have narrower windows, half a width apart.
WINDOW, STRIDE = 32, 16
WIDTHS = (8, 16, WINDOW)
#: Benchmark words in a block: its items and the basis (a row of RANK floats for each different word) are sent to every task.
BLOCK_WORDS = 20_000
#: Blocks that one reading of the documents serves.
TOGETHER = 4
#: How much of the least cosine by equal weights a candidate needs, as weights differ; least share of a passage's words in common order, and that with most answer words.
SLACK, SAME, ALIKE, ANSWERS = 0.8, 0.6, 0.45, 0.7
#: How many of a passage's rarest words are its answer, where no answer is given.
RAREST = 5
CLEAN = re.compile(r"[\W_]+")
#: Scripts without spaces, whose words are their characters: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
HITS = "item_id long, cosine double, common_share double, answer_share double, start_word long, end_word long"


def word_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the parts of words without their punctuation and case, and how many each word has: none without a letter or digit."""
    out, sizes = [], []
    for word in words:
        parts = (word if word.isascii() else UNSPACED.sub(r" \g<0> ", word)).lower().split()
        own = [xxhash.xxh64_intdigest(clean.encode(), 3) | 1 for x in parts if (clean := x if x.isalnum() else CLEAN.sub("", x))]
        out += own
        sizes.append(len(own))
    return np.array(out, np.uint64), np.array(sizes, np.int64)


class Words:
    """Word ids of texts. A word ends at white space, or at a mark after a letter; characters of unspaced scripts are words."""

    def __init__(self):
        self.table = WordTable(np.dtype(np.uint64), word_ids)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        layout = Layout(texts)
        ids, sizes = self.table.of(layout)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[layout.per_text()], prepend=0)

    def ids(self, text: str) -> np.ndarray:
        return self.of([text])[0]


def features(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(48)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many documents have each feature, and how many documents with words there are."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(FEATURES + 1, np.int64)
        for batch in slices(batches, 0):
            ids, sizes = words.of([t or "" for t in batch.column(0).to_pylist()])
            own = np.repeat(np.arange(len(sizes), dtype=np.uint32) << np.uint32(16), sizes) | (ids >> np.uint64(48)).astype(np.uint32)  # a slice has at most 2**16 rows
            own.sort()
            own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
            total[:FEATURES] += np.bincount(own & np.uint32(0xFFFF), minlength=FEATURES)
            total[FEATURES] += int((sizes > 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for feature, n in rows.collect():  # at most FEATURES + 1 rows
        out[feature] = n
    return out[:FEATURES], int(out[FEATURES])


def weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return np.log((1 + documents) / (1 + frequencies)) + 0.05


def vector(ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage as distinct words and TF-IDF values of length one; a word's weight is its feature's."""
    own, n = np.unique(ids, return_counts=True)
    value = n * weight[features(own)]
    return own, value / max(1e-12, float(np.sqrt((value * value).sum())))


def random_rows(ids: np.ndarray, rank: int) -> np.ndarray:
    """The rows of the SVD's Gaussian test matrix that belong to these words."""
    return np.stack([np.random.default_rng([5, int(x)]).standard_normal(rank) for x in ids]) if len(ids) else np.zeros((0, rank))


def latent_basis(passages: DataFrame, weight: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(words, basis): right singular vectors of the passages' TF-IDF matrix A, a row per word.

    Halko, Martinsson and Tropp's scheme: tasks sum their shares of A'(A Omega) and of the small Gram matrix of A Q;
    the driver has the factors of one block, so of at most BLOCK_WORDS x rank values.
    """
    sent = passages.sparkSession.sparkContext.broadcast(weight)

    @frugal
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own, value = vector(words.ids(text or ""), sent.value)
                image = value @ random_rows(own, rank)
                for w, v in zip(own.view(np.int64).tolist(), value, strict=True):
                    total[w] = total.get(w, 0) + v * image
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["word", "part"])

    parts = passages.select("text").mapInArrow(sketch, "word long, part array<double>")
    sums = parts.select("word", F.posexplode("part").alias("k", "x")).groupBy("word", "k").agg(F.sum("x").alias("x")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("own"))
    rows = sums.select("word", "own.x").toArrow().combine_chunks()  # bounded by BLOCK_WORDS
    if not rows.num_rows:
        return np.zeros(0, np.uint64), np.zeros((0, rank))
    known = rows["word"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known = known[order]
    image = pa.compute.list_flatten(rows["x"]).to_numpy().reshape(len(known), rank)[order]
    q, r = np.linalg.qr(image)
    q = q[:, np.abs(np.diag(r)) > 1e-9 * np.abs(np.diag(r)).max()]
    basis = passages.sparkSession.sparkContext.broadcast(q)

    @frugal
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros((basis.value.shape[1],) * 2)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own, value = vector(words.ids(text or ""), sent.value)
                image = value @ basis.value[np.searchsorted(known, own)]
                total += np.outer(image, image)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "x"])

    small = np.zeros((q.shape[1],) * 2)
    for i, j, x in passages.select("text").mapInArrow(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x")).collect():  # at most rank x rank
        small[i, j] = x
    values, turn = np.linalg.eigh(small)
    return known, q @ turn[:, values > 1e-9 * max(values.max(), 1e-300)]


def common_length(a: list[int], b: list[int]) -> int:
    """The longest common subsequence of words, with a machine word's bits (here an integer's) for the cells of a column."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def chunks(text: str) -> list[str]:
    """A passage in even parts of about WINDOW words."""
    words = (text if text.isascii() else UNSPACED.sub(r" \g<0> ", text)).split()
    words = [w for w in words if CLEAN.sub("", w)]
    parts = max(1, round(len(words) / WINDOW))
    cuts = [len(words) * i // parts for i in range(parts + 1)]
    return [" ".join(words[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]


def parted(items: DataFrame) -> DataFrame:
    """items(item_id, text, answer) with their chunks."""

    @frugal
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([chunks(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=["item_id", "text", "answer", "chunks"])

    return items.select("item_id", "text", "answer").mapInArrow(part, "item_id long, text string, answer string, chunks array<string>")


def width_of(length: int) -> int:
    return next((w for w in WIDTHS if length < 1.5 * w), WINDOW)


def least_cosine(length: int, width: int) -> float:
    """The gate for a chunk: by equal weights, what the best window has of a chunk of which the share ALIKE is in place."""
    inside = min(length, width / 4 + length / 2)
    return SLACK * ALIKE * inside / (length * width) ** 0.5


class Index:
    """A block of passages in the latent space; the chunks of a passage each propose it."""

    def __init__(self, items: list[tuple], weight: np.ndarray, known: np.ndarray, basis: np.ndarray):
        words = Words()
        self.weight = weight
        self.known, self.basis = known, basis.astype(np.float32)
        self.maybe = np.zeros(FEATURES, bool)
        self.maybe[features(known)] = True
        self.items, entries = [], {w: [] for w in WIDTHS}
        for item_id, text, answer, parts in items:
            ids = words.ids(text or "")
            if not len(ids):
                continue
            rare = ids[np.argsort(-weight[features(ids)], kind="stable")]
            told = set(words.ids(answer).tolist()) if answer else set([*dict.fromkeys(rare.tolist())][:RAREST])
            for part in parts:
                own = words.ids(part)
                entries[width_of(len(own))].append((len(self.items), own))
            self.items.append((item_id, ids.tolist(), told))
        self.classes = [(w, *self.projected(own, w)) for w, own in entries.items() if own]

    def projected(self, entries: list[tuple[int, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(scores, gates, items) of chunks: what each word adds to a window's product with each chunk, in the latent space.

        A chunk that the basis doesn't hold whole takes its own values.
        """
        vectors = [vector(ids, self.weight) for _, ids in entries]
        places = [np.searchsorted(self.known, own) for own, _ in vectors]
        latent = np.array([value @ self.basis[at] for (_, value), at in zip(vectors, places, strict=True)]).reshape(len(entries), -1)
        norm = np.linalg.norm(latent, axis=1)
        scores = self.basis @ (latent / np.maximum(norm, 1e-12)[:, None]).T.astype(np.float32)
        for i in np.flatnonzero(norm < 0.999).tolist():
            scores[:, i] = 0
            scores[places[i], i] = vectors[i][1]
        return scores, np.array([least_cosine(len(ids), width) for _, ids in entries], np.float32), [i for i, _ in entries]

    def candidates(self, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
        """(text, cosine, window's first word, its width, item) above the gates, of texts one after the other.

        Windows are two neighbouring steps of half a width; texts are a step apart. A window's bound by the
        greatest score of each of its words comes first.
        """
        feature = features(ids)
        at = np.flatnonzero(self.maybe[feature])
        place = np.minimum(np.searchsorted(self.known, ids[at]), len(self.known) - 1)
        same = self.known[place] == ids[at]
        at, row = at[same], place[same]
        if not len(at):
            return
        weight = self.weight[feature]
        square, own = weight * weight, weight[at].astype(np.float32)
        text = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for width, scores, gates, items in self.classes:
            stride = width // 2
            steps = -(-sizes // stride) + 1
            base = np.cumsum(steps) - steps
            step = base[text] + place // stride
            known, n = step[at], int(steps.sum()) + 1
            every, most = np.bincount(step, square, n), np.bincount(known, own * scores.max(1)[row], n)
            every, most = every[:-1] + every[1:], most[:-1] + most[1:]
            live = np.flatnonzero((most >= 0.9999 * float(gates.min()) * np.sqrt(every)) & (np.bincount(known, minlength=n)[:-1] + np.bincount(known, minlength=n)[1:] > 0))
            for low in range(0, len(live), 512):
                part = live[low : low + 512]
                first, count = np.searchsorted(known, part), np.searchsorted(known, part + 2) - np.searchsorted(known, part)
                ends = np.cumsum(count)
                which = np.arange(ends[-1]) + np.repeat(first - ends + count, count)
                sums = np.add.reduceat(own[which, None] * scores[row[which]], ends - count, axis=0)
                w, i = np.nonzero(sums >= gates * np.sqrt(every[part])[:, None])
                cosine = sums[w, i] / np.sqrt(every[part[w]])
                doc = np.searchsorted(base, part[w], "right") - 1
                yield from zip(doc.tolist(), cosine.tolist(), ((part[w] - base[doc]) * stride).tolist(), [width] * len(w), (items[k] for k in i.tolist()), strict=True)

    def hits(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        """(text, *HITS) of texts one after the other, by text and item."""
        if not len(ids) or not self.items or not len(self.known):
            return []
        best: dict[tuple[int, int], tuple] = {}
        starts = np.cumsum(sizes) - sizes
        for text, cosine, start, width, i in self.candidates(ids, sizes):
            item_id, own, told = self.items[i]
            n, base = int(sizes[text]), int(starts[text])
            low, high = max(0, start - len(own)), min(n, start + width + len(own))
            part = ids[base + low : base + high].tolist()
            seen = set(part)
            if sum(map(seen.__contains__, own)) < ALIKE * len(own):  # no common subsequence is longer
                continue
            share = common_length(own, part) / len(own)
            answers = sum(x in seen for x in told) / max(1, len(told))
            if share >= SAME or (share >= ALIKE and answers >= ANSWERS):
                row = (item_id, min(1.0, round(cosine, 4)), round(share, 4), round(answers, 4), start, min(start + width, n))
                old = best.get((text, i))
                if old is None or (row[2], row[1], -row[4]) > (old[2], old[1], -old[4]):
                    best[text, i] = row
        return [(text, *best[text, i]) for text, i in sorted(best)]


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, common_share, answer_share, start_word, end_word): each document's best window for every passage it holds.

    benchmark(item_id, text[, answer]). Null and empty texts and passages hold nothing; repeated rows of either side
    give rows of their own; ties go to the earlier window. An empty table gives no rows; other columns are ignored.
    """
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    items = written(parted(items), "items")
    total, parts = (x or 0 for x in items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))), F.sum(F.size("chunks"))).first())
    blocks = max(1, -(-total // BLOCK_WORDS), 1 if parts <= rank else -(-parts * 4 // (rank * 3)))  # dealt by hash, so with room
    frequencies, n = document_frequencies(docs, text_col)
    weight = weights(frequencies, n)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, {HITS}"
    context, found = docs.sparkSession.sparkContext, []
    for low in range(0, blocks, TOGETHER):
        sent = []
        for block in range(low, min(blocks, low + TOGETHER)):
            own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
            known, basis = latent_basis(own.select(F.explode("chunks").alias("text")), weight, rank)
            sent.append(context.broadcast(([tuple(r) for r in own.orderBy("item_id", "text").collect()], weight, known, basis)))  # bounded by BLOCK_WORDS

        @frugal
        def search(batches: Iterator[pa.RecordBatch], sent=tuple(sent)) -> Iterator[pa.RecordBatch]:
            indexes, words = [Index(*x.value) for x in sent], Words()
            for batch in slices(batches):
                every, sizes = words.of([t or "" for t in batch.column(1).to_pylist()])
                found_here = sorted((hit for index in indexes for hit in index.hits(every, sizes)), key=lambda x: x[0])
                own = batch.column(0).to_pylist()
                rows = [(own[x[0]], *x[1:]) for x in found_here]
                kinds = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                cols = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", *[x.split()[0] for x in HITS.split(", ")]])

        found.append(src.mapInArrow(search, schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that hold no passage; rows without id stay."""
    bad = leaks(docs, benchmark, id_col=id_col).where(F.col(id_col).isNotNull()).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
