"""Words on pages: locating texts and objects by running character offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_offsets(words: DataFrame, norm) -> DataFrame:
    """Adds each word's comparable form and where it starts and stops in its page's string of those."""
    rows = words.withColumn("norm", norm(F.col("text")))
    order = W.partitionBy("page_id").orderBy("word_no")
    stop = F.sum(F.length("norm")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("norm"))


def locate_text(words: DataFrame, targets: DataFrame, norm) -> DataFrame:
    """(page_id, target_id, first_word, last_word, left, right, quality): runs of words whose joined form is a target's.

    A run starts and stops on word borders; words without comparable characters also open one. Words that begin a target
    meet it by page and first character; where the target's length ends on a border too, the words between are joined and compared. quality
    tells whether the words as they stand make the target (exact_text) or their comparable forms do (normalized_text).
    """
    rows = with_offsets(words, norm)
    goals = targets.select("page_id", "target_id", "target", norm(F.col("target")).alias("goal")).where("goal <> ''")
    heads = rows.where("norm <> ''").select("page_id", F.substring("norm", 1, 1).alias("letter"), F.col("start").alias("at"), F.col("norm").alias("head"), F.col("word_no").alias("head_word"))
    met = goals.withColumn("letter", F.substring("goal", 1, 1)).join(heads, ["page_id", "letter"]).where(F.col("goal").startswith(F.col("head")))
    # words without a letter of their own begin where the next one does; they and the words at the end are asked for in one join
    asked = met.withColumn("_ask", F.explode(F.array(F.struct(F.lit(True).alias("opens"), F.col("at").alias("place")), F.struct(F.lit(False).alias("opens"), (F.col("at") + F.length("goal")).alias("place")))))
    asked = asked.select("page_id", "target_id", "target", "goal", "head_word", "_ask.opens", "_ask.place")
    marks = rows.where("norm is not null").select("page_id", (F.col("norm") == "").alias("opens"), F.when(F.col("norm") == "", F.col("start")).otherwise(F.col("stop")).alias("place"), F.col("word_no").alias("_at"))
    ends = asked.join(marks, ["page_id", "opens", "place"]).groupBy("page_id", "target_id", "target", "goal", "head_word").agg(F.collect_list(F.when(F.col("opens"), F.col("_at"))).alias("_before"), F.max(F.when(~F.col("opens"), F.col("_at"))).alias("last_word"))
    opened = ends.where("last_word is not null").withColumn("first_word", F.explode(F.array_append("_before", F.col("head_word")))).drop("_before", "head_word")
    runs = opened.where("first_word <= last_word").withColumn("word_no", F.explode(F.sequence("first_word", "last_word")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", c))), lambda x: x[c]), "")
    said = runs.join(words.select("page_id", "word_no", "text", "x0", "x1"), ["page_id", "word_no"]).withColumn("norm", norm(F.col("text"))).groupBy("page_id", "target_id", "target", "goal", "first_word", "last_word").agg(joined("norm").alias("said"), joined("text").alias("raw"), F.min("x0").alias("left"), F.max("x1").alias("right"))
    return said.where("said = goal").select("page_id", "target_id", "first_word", "last_word", "left", "right", F.when(F.col("raw") == F.col("target"), "exact_text").otherwise("normalized_text").alias("quality"))


def disambiguate(hits: DataFrame, context: DataFrame) -> DataFrame:
    """Of several hits of a target the one with the most context: texts before it earlier, texts after it later; only a single best one above zero wins."""
    pairs = hits.join(context, ["page_id", "target_id"], "left")
    good = (F.col("side") == "before") & (F.col("context_word") < F.col("first_word")) | (F.col("side") == "after") & (F.col("context_word") > F.col("last_word"))
    score = pairs.groupBy("page_id", "target_id", "first_word", "last_word").agg(F.count_if(good).alias("score"))
    best = score.withColumn("_top", F.max("score").over(W.partitionBy("page_id", "target_id"))).where("score = _top")
    n = F.count("*").over(W.partitionBy("page_id", "target_id"))
    return best.withColumn("_n", n).where("_n = 1 and score > 0").drop("_top", "_n")


def locate_gaps(objects: DataFrame, boxes: DataFrame) -> DataFrame:
    """(object_id, page, x0, y0, x1, y1): where an object without a text of its own lies, between what stands before and after it; null without a single such gap.

    boxes(object_id, page, side, x0, y0, x1, y1): places of the text before (side before) and after it. A gap is a pair of
    one page with the first ending where the second begins, or above. Along a page, each place after meets the number of
    places before that have ended by then, so gaps are counted without making the pairs.
    """
    at = F.when(F.col("side") == "before", F.col("y1")).otherwise(F.col("y0"))
    along = W.partitionBy("object_id", "page").orderBy(at, F.col("side") == "after").rowsBetween(W.unboundedPreceding, 0)
    first = F.when(F.col("side") == "before", F.struct("x0", "y1", "x1"))
    rows = boxes.select("*", F.count(first).over(along).alias("_n"), F.last(first, ignorenulls=True).over(along).alias("_b")).where("side = 'after' and _n > 0")
    gap = F.struct("page", F.least("x0", "_b.x0").alias("x0"), F.col("_b.y1").alias("y0"), F.greatest("x1", "_b.x1").alias("x1"), F.col("y0").alias("y1"))
    only = rows.groupBy("object_id").agg(F.sum("_n").alias("_gaps"), F.max(gap).alias("_gap")).where("_gaps = 1")
    return objects.select("object_id").join(only, "object_id", "left").select("object_id", "_gap.*")


def objects_on_page(objects: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Objects found on a page and all below them by locator, the first `limit` of each page, with an overflow flag."""
    parts = F.split("locator", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = objects.select("*", F.explode(prefixes).alias("_p")).join(found.select("doc_id", "page", F.col("locator").alias("_p")), ["doc_id", "_p"]).drop("_p").distinct()
    page = W.partitionBy("doc_id", "page")
    ranked = rows.withColumn("_r", F.row_number().over(page.orderBy("locator"))).withColumn("overflow", F.count("*").over(page) > limit)
    return ranked.where(F.col("_r") <= limit).drop("_r")


def page_coverage(reviews: DataFrame, renders: DataFrame) -> DataFrame:
    """Whether the reviewed pages of a document are exactly 1 to n without blocking findings."""
    own = reviews.groupBy("doc_id").agg(F.collect_set("page").alias("_seen"), F.bool_or("blocking").alias("_blocked"))
    rows = renders.join(own, "doc_id", "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<bigint>")))
    every = F.sequence(F.lit(1).cast("bigint"), F.col("pages"))
    return rows.select("doc_id", F.size(F.array_except(every, "_seen")).cast("long").alias("unseen"), F.size(F.array_except("_seen", every)).cast("long").alias("unknown"), F.coalesce("_blocked", F.lit(False)).alias("blocked"))
