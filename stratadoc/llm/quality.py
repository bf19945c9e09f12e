"""Quality by interpolated modified Kneser-Ney models over characters.

One model is counted over trusted text (labelled good and not toxic), and a second one over text labelled toxic. A
word is read on its own, from the space before it to the space after it, in n-grams of four characters of its
document's language. A document's perplexity is the trusted model's; its contrast is the mean log ratio of both
models over its few words that fit the trusted model least. Quantiles of both among each language's trusted
documents that the models haven't seen are the thresholds.

Texts stay in compressed blobs. Each blob asks for its distinct n-grams, by shards; each n-gram's probability is
found once, by joins of counts; each shard answers its blobs. So counts cover all trusted text, and no model is
sent to every task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_written, frugal, give_back, release, single_rows, slices, written

ORDER, BITS = 4, 12
BLOB = 8 << 20
#: Shards of n-grams (their number grows with the root of that of the blobs between these bounds), and bytes of requests that one task answers.
SHARDS, ANSWERED = (64, 512), 64 << 20
#: The share of a document's words that its contrast looks at.
WORST = 0.02
#: Trusted documents above this quantile of perplexity, or below this one of contrast, would be rejected.
HIGH, LOW = 0.995, 0.01
#: One trusted document of so many is kept out of the model and gives thresholds; languages with fewer such documents than ENOUGH take the looser of their own and the overall threshold.
HELD_OUT, ENOUGH = 5, 200
TRUSTED, TOXIC = 1, 2
SPACE = 1
#: Log probabilities travel as 16-bit multiples of this; the last value means none.
GRAIN, NONE = 1 / 2048, 0xFFFF
#: The language of the models over all languages, which serve where a language lacks trusted or toxic text.
ANY = 0
COUNT = {TRUSTED: "t", TOXIC: "x"}


def store(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    src = docs.select(F.col(id_col), F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    schema = f"blob long, ids array<{src.schema[0].dataType.simpleString()}>, langs array<string>, sizes array<long>, n_bytes long, data binary"

    @frugal
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1, BLOB):
            data = [(t or "").encode() for t in batch.column(1).to_pylist()]
            row = (number, batch.column(0).to_pylist(), batch.column(2).to_pylist(), [*map(len, data)], sum(map(len, data)), zstandard.compress(b"".join(data), 9))
            kinds = [pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["blob", "ids", "langs", "sizes", "n_bytes", "data"])
            number += 1

    return src.mapInArrow(fill, schema)


_SPACES: list[np.ndarray] = []


def spaces() -> np.ndarray:
    """White space among the code points below 2**16."""
    if not _SPACES:
        _SPACES.append(np.array([chr(c).isspace() for c in range(1 << 16)]))
    return _SPACES[0]


def lang_code(lang: str | None) -> int:
    """15 bits of language; never ANY."""
    return 1 + zlib.crc32((lang or "").encode()) % 0x7FFF


def grams(text: str, lang: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of each n-gram of a text, and where each word's begin: 15 bits of language, then 12 for each character.

    A character above U+07FF shares its 12 bits with others.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = spaces()[np.minimum(points, 0xFFFF)]
    ids = np.where(points < 2048, points, 2048 + (points * np.uint32(2654435761) >> np.uint32(21))).astype(np.int64)
    ids[gap] = SPACE
    ids = np.concatenate([[SPACE], ids, [SPACE]])
    blank = np.concatenate([[True], gap, [True]])
    ids = ids[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    if len(ids) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    back = [ids[1:]]
    for k in range(1, ORDER):
        own = np.concatenate([np.full(k - 1, SPACE), ids[: len(ids) - k]])
        back.append(own if k == 1 else np.where(back[-1] == SPACE, SPACE, own))
    code = np.full(len(ids) - 1, lang, np.int64)
    for x in reversed(back):
        code = (code << BITS) | x
    starts = np.flatnonzero(np.concatenate([[True], ids[1:-1] == SPACE]))
    return code, starts


def texts(row: dict) -> Iterator[str]:
    data = zstandard.decompress(row["data"]) if row["n_bytes"] else b""
    at = 0
    for n in row["sizes"]:
        yield data[at : at + n].decode()
        at += n


def held_out(id_column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % HELD_OUT == 0


def classes(blobs: DataFrame, labels: DataFrame) -> DataFrame:
    """(blob, classes): places of labelled documents in each blob. A document is toxic if any of its labels says so, trusted if all call it good.

    Trusted documents that are held out have no class.
    """
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").try_cast(blobs.schema["ids"].dataType.elementType).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = own.select("id", F.when(F.col("toxic") == 1, TOXIC).when((F.col("quality") == 1) & ~held_out(F.col("id")), TRUSTED).alias("class")).where("class is not null")
    places = blobs.select("blob", F.posexplode("ids").alias("place", "id"))
    return places.join(own, "id").groupBy("blob").agg(F.collect_list(F.struct("place", "class")).alias("classes"))


def counted(blobs: DataFrame) -> DataFrame:
    """(class, code, n) of labelled documents."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            of = {x["place"]: x["class"] for x in row["classes"]}
            found = {TRUSTED: [], TOXIC: []}
            for i, text in enumerate(texts(row)):
                if i in of:
                    found[of[i]].append(grams(text, lang_code(row["langs"][i]))[0])
            for kind, codes in found.items():
                if codes:
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), pa.array(code), pa.array(n)], names=["class", "code", "n"])

    return blobs.mapInArrow(count, "class int, code long, n long").groupBy("class", "code").agg(F.sum("n").alias("n"))


def shorter(code: str, order: int):
    """The code without its first character."""
    keep = BITS * (order - 1)
    return F.shiftleft(F.shiftright(F.col(code), BITS * ORDER), BITS * ORDER).bitwiseOR(F.col(code).bitwiseAND(F.lit((1 << keep) - 1)))


def context(code: str):
    return F.shiftright(F.col(code), BITS)


def discounts(counts: DataFrame) -> dict[tuple[int, bool], list[float]]:
    """For each (class, free) its discounts of counts 1, 2 and more, by Chen and Goodman's counts of counts, held inside (0, 1), (0, 2) and (0, 3).

    free: the model of all languages in one.
    """
    out = {}
    for kind, free, *n in counts.groupBy("class", "free").agg(*[F.greatest(F.count_if(F.col("n") == k), F.lit(1)) for k in range(1, 5)]).collect():  # four rows at most
        y = n[0] / (n[0] + 2 * n[1])
        out[kind, free] = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.1) for k in (1, 2, 3)]
    return out


def models(n4: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order two written tables: (code, a_t, a_x), discounted shares of seen n-grams, and (context, g_t, g_x), what the shorter one gets.

    Shorter n-grams count the different characters seen before them.
    """
    out, counts = {}, n4
    for order in range(ORDER, 0, -1):
        rows = counts.withColumn("free", F.shiftright("code", BITS * ORDER) == ANY)
        off = F.lit(None).cast("double")
        for (kind, free), d in discounts(rows).items():
            own = (F.col("class") == kind) & (F.col("free") == free)
            off = F.when(own, F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(off)
        rows = rows.select("class", "code", context("code").alias("context"), "n", off.alias("off"))
        of = rows.groupBy("class", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("g"))
        seen = rows.join(of, ["class", "context"]).withColumn("a", F.greatest(F.col("n") - F.col("off"), F.lit(0.0)) / F.col("total"))
        pick = lambda c, k: F.max(F.when(F.col("class") == k, F.col(c)))
        out[order] = (
            written(seen.groupBy("code").agg(*[pick("a", k).alias(f"a_{s}") for k, s in COUNT.items()]), f"seen{order}"),
            written(of.groupBy("context").agg(*[pick("g", k).alias(f"g_{s}") for k, s in COUNT.items()]), f"of{order}"),
        )
        if order > 1:
            counts = written(counts.groupBy("class", shorter("code", order).alias("code")).agg(F.count("*").alias("n")), f"counts{order - 1}")
    return out


def probabilities(codes: DataFrame, n4: DataFrame) -> DataFrame:
    """(code, l_t, l_x): log probability of each n-gram under both models, null for a model without text of its language."""
    tables, rows, own = models(n4), codes, "code"
    for order in range(ORDER, 0, -1):
        seen, of = tables[order]
        rows = rows.withColumn("key", F.col(own)).join(seen.withColumnRenamed("code", "key").toDF("key", f"a_t{order}", f"a_x{order}"), "key", "left")
        rows = rows.withColumn("key", context("key")).join(of.toDF("key", f"g_t{order}", f"g_x{order}"), "key", "left").drop("key")
        if order > 1:
            rows = rows.withColumn(f"code{order - 1}", shorter(own, order))
            own = f"code{order - 1}"
    out = [F.col("code")]
    for s in COUNT.values():
        p = F.lit(1.0 / (1 << BITS))
        for order in range(1, ORDER + 1):
            g = F.col(f"g_{s}{order}")
            p = F.when(g.isNull(), p).otherwise(F.coalesce(F.col(f"a_{s}{order}"), F.lit(0.0)) + g * p)
        out.append(F.when(F.col(f"g_{s}1").isNotNull(), F.log(p)).cast("float").alias(f"l_{s}"))
    return rows.select(*out)


def with_any(n4: DataFrame) -> DataFrame:
    """The counts together with those of all languages in one."""
    free = F.col("code").bitwiseAND(F.lit((1 << BITS * ORDER) - 1))
    return n4.unionByName(n4.groupBy("class", free.alias("code")).agg(F.sum("n").alias("n")))


def modelled(n4: DataFrame) -> set[int]:
    """Languages with both trusted and toxic text; at most 2**15."""
    lang = F.shiftright("code", BITS * ORDER)
    return {r[0] for r in n4.where(lang != ANY).groupBy(lang.alias("lang")).agg(F.count_distinct("class").alias("n")).where("n = 2").select("lang").collect()}


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def model_lang(lang: str | None, known: set[int]) -> int:
    return code if (code := lang_code(lang)) in known else ANY


def codes_of(row: dict, known: set[int]) -> np.ndarray:
    """The distinct n-grams of a blob, in order."""
    every, held = np.zeros(0, np.int64), []
    for text, lang in zip(texts(row), row["langs"], strict=True):
        held.append(np.unique(grams(text, model_lang(lang, known))[0]))
        if sum(map(len, held[-64:])) > 1 << 20 or len(held) >= 512:
            every, held = np.unique(np.concatenate([every, *held])), []
    return np.unique(np.concatenate([every, *held]))


def requests(blobs: DataFrame, known: set[int], shards: int) -> DataFrame:
    """(shard, blob, codes): the distinct n-grams of each blob, in order."""

    @frugal
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            code = codes_of(row, known)
            shard = shard_of(code, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
            rows = [(s, row["blob"], pack(np.diff(code[order[a:b]], prepend=0))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["shard", "blob", "codes"])

    return blobs.mapInArrow(ask, "shard int, blob long, codes binary")


def pack(x: np.ndarray) -> bytes:
    """Compressed, byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 3)


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def distinct_codes(asked: DataFrame) -> DataFrame:
    @frugal
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(unpack(codes, np.int64)))], names=["code"])

    return asked.select("codes").mapInArrow(each, "code long").distinct()


def grained(logs: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(logs), NONE, np.minimum(np.round(-np.nan_to_num(logs) / GRAIN), NONE - 1)).astype(np.uint16)


def ungrained(grains: np.ndarray) -> np.ndarray:
    return np.where(grains == NONE, np.nan, grains * -GRAIN)


def answers(asked: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """(blob, shard, l_t, l_x): the log probabilities of each request's n-grams, in its order.

    A task has a shard of the n-grams and the requests of a group of blobs; there are as many groups as keep a task's
    requests to about ANSWERED bytes, and each gets a copy of the shard.
    """

    def answer(ask: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("code")
        code, logs = known["code"].to_numpy(np.int64), [grained(known[c].to_numpy(np.float64)) for c in ("l_t", "l_x")]
        rows = []
        for row in ask.itertuples():
            at = np.searchsorted(code, np.cumsum(unpack(row.codes, np.int64)))
            rows.append((row.blob, row.shard, *(pack(x[at]) for x in logs)))
        give_back()
        return pd.DataFrame(rows, columns=["blob", "shard", "l_t", "l_x"])

    def sharded(codes: pd.Series) -> pd.Series:
        return pd.Series(shard_of(codes.to_numpy(np.int64), shards).astype(np.int32))

    size = asked.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    groups = max(1, -(-size // (ANSWERED * shards)))
    keyed = found.withColumn("shard", F.pandas_udf(sharded, "int")("code")).withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    mine = asked.withColumn("of", F.pmod(F.xxhash64("blob"), F.lit(groups)).cast("int"))
    return mine.groupBy("of", "shard").cogroup(keyed.groupBy("of", "shard")).applyInPandas(answer, "blob long, shard int, l_t binary, l_x binary")


def scores(blobs: DataFrame, answered: DataFrame, known: set[int], shards: int) -> DataFrame:
    """Per document: words, perplexity under the trusted model, and contrast; null where there is no word or no model."""

    kind = to_arrow_type(blobs.schema["ids"].dataType.elementType)

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            code = codes_of(row, known)
            shard, trusted, toxic = shard_of(code, shards), np.full(len(code), np.nan), np.full(len(code), np.nan)
            for x in row["answers"] or []:
                of = shard == x["shard"]
                trusted[of], toxic[of] = (ungrained(unpack(x[k], np.uint16)) for k in ("l_t", "l_x"))
            rows = []
            for doc, lang, text in zip(row["ids"], row["langs"], texts(row), strict=True):
                own, starts = grams(text, model_lang(lang, known))
                words, perplexity, contrast = len(starts), None, None
                if words:
                    at = np.searchsorted(code, own)
                    mean = trusted[at].mean()
                    if not np.isnan(mean):
                        perplexity = round(float(np.exp(-mean)), 4)
                        ratio = np.add.reduceat(trusted[at] - toxic[at], starts)
                        k = -int(-WORST * words // 1)
                        worst = np.partition(ratio, k - 1)[:k].mean()
                        contrast = None if np.isnan(worst) else round(float(worst), 4)
                rows.append((doc, lang, words, perplexity, contrast))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, pa.string(), pa.int64(), pa.float64(), pa.float64()], strict=True)], names=["doc_id", "lang", "n_words", "perplexity", "contrast"])

    gathered = answered.groupBy("blob").agg(F.collect_list(F.struct("shard", "l_t", "l_x")).alias("answers"))
    return blobs.join(gathered, "blob", "left").mapInArrow(score, f"doc_id {blobs.schema['ids'].dataType.elementType.simpleString()}, lang string, n_words long, perplexity double, contrast double")


def judged(docs: DataFrame, labels: DataFrame, high: float = HIGH, low: float = LOW, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_words, perplexity, contrast, accepted) of every row, after labels(doc_id, quality, toxic).

    Rejected: perplexity above, or contrast below, its language's quantile among trusted documents that were held out of
    the models; with few of those in a language, the looser of its own and the quantile over all counts. A language that lacks trusted or toxic text is judged by models over all
    languages. A text without words (null, empty) is rejected. Where nothing is trusted, or nothing toxic, that test
    rejects nothing. Rows without language are a language; rows without id are never labelled; labels of ids that
    documents can't have are passed over; repeated rows count as often as they come; other columns are ignored; an
    empty table gives no rows.
    """
    blobs = written(store(docs, id_col, text_col, lang_col), "blobs")
    kinds = classes(blobs.select("blob", "ids"), labels)
    own = written(counted(blobs.join(kinds, "blob").select("langs", "sizes", "n_bytes", "data", "classes")), "counts")
    n4 = written(with_any(own), "counts4")
    drop_written(own)
    release(docs.sparkSession)
    known = modelled(n4)
    shards = min(SHARDS[1], max(SHARDS[0], math.isqrt(blobs.count())))
    light = blobs.select("blob", "langs", "sizes", "n_bytes", "data")
    asked = written(requests(light, known, shards), "requests")
    found = written(probabilities(distinct_codes(asked), n4), "probabilities")
    answered = written(answers(asked, found, shards), "answers")
    drop_written(asked, found, n4)
    release(docs.sparkSession)
    each = written(scores(blobs.select("blob", "ids", "langs", "sizes", "n_bytes", "data"), answered, known, shards), "scores")
    drop_written(answered, blobs)
    own = labels.groupBy(F.col("doc_id").try_cast(docs.schema[id_col].dataType).alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    trusted = each.join(own, "doc_id", "left_semi").where("n_words > 0").withColumn("held", held_out(F.col("doc_id")))
    cut = [F.percentile_approx("perplexity", high, 100_000).alias("high"), F.percentile_approx("contrast", low, 100_000).alias("low")]
    by_lang = trusted.where("held").groupBy(F.col("lang").alias("of")).agg(*cut, F.count("*").alias("n"))
    some, every = trusted.where("held").agg(*cut).first(), trusted.agg(*cut).first()
    most, least = (F.lit(a if a is not None else b).cast("double") for a, b in zip(some, every, strict=True))
    rows = each.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left")
    enough = F.col("n") >= ENOUGH
    limits = F.when(enough, F.col("high")).otherwise(F.greatest("high", most)), F.when(enough, F.col("low")).otherwise(F.least("low", least))
    bad = F.coalesce(F.col("perplexity") > limits[0], F.lit(False)) | F.coalesce(F.col("contrast") < limits[1], F.lit(False)) | (F.col("n_words") == 0)
    return rows.select(F.col("doc_id").alias(id_col), "lang", "n_words", "perplexity", "contrast", (~bad).alias("accepted"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose text is accepted. Rows of one id are kept or dropped together; rows without id go by no verdict and stay."""
    bad = judged(docs, labels, id_col=id_col).where(~F.col("accepted") & F.col(id_col).isNotNull()).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
