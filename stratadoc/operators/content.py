"""The content model: hierarchy, captions, coverage, context and batches of ordered items of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .patterns import held_strings

HEADING = r"^body\.heading\.outline([1-5])$"


def in_document(*order: str):
    return W.partitionBy("doc_id").orderBy(*(order or ("block", "inline")))


def bind_hierarchy(items: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Adds parent_id: the nearest open heading above. A heading closes all of its level and below.

    Level k is open where the last heading of it came after the last of every higher level; so one window with five
    running maxima does it. Only body items take part; others have no parent.
    """
    before = in_document().rowsBetween(W.unboundedPreceding, -1)
    level = F.when(F.col("field_id").rlike(HEADING), F.regexp_extract("field_id", HEADING, 1).cast("int"))
    rows = items.withColumn("_level", level).withColumn("_place", F.struct("block", "inline", id_col))
    for k in range(1, 6):
        rows = rows.withColumn(f"_at{k}", F.max(F.when(F.col("_level") == k, F.col("_place"))).over(before))
    parent: Column = F.lit(None)
    for k in range(1, 6):  # the deepest open level below the row's own wins, so it is asked last
        higher = [F.coalesce(F.col(f"_at{k}") > F.col(f"_at{j}"), F.lit(True)) for j in range(1, k)]
        opened = F.col(f"_at{k}").isNotNull() & (F.col("_level").isNull() | (F.col("_level") > k))
        for h in higher:
            opened = opened & h
        parent = F.when(opened, F.col(f"_at{k}.{id_col}")).otherwise(parent)
    parent = F.when(F.col("field_id").startswith("body."), parent)
    return rows.withColumn("parent_id", parent).select(*items.columns, "parent_id")


def field_results(items: DataFrame) -> DataFrame:
    """Per document and field of classified items: how many, and their ids in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "inline", "object_id"))), lambda x: x["object_id"])
    return items.where((F.col("status") == "classified") & F.col("field_id").isNotNull()).groupBy("doc_id", "field_id").agg(F.count("*").alias("item_count"), ordered.alias("content_ids"))


def doc_status(items: DataFrame, coverage: DataFrame) -> DataFrame:
    """UNSUPPORTED before NEEDS_REVIEW before READY, from items' statuses and whether coverage found unsupported objects."""
    own = items.groupBy("doc_id").agg(F.max((F.col("status") == "unsupported").cast("int")).alias("u"), F.max(F.col("status").isin("ambiguous", "unknown").cast("int")).alias("r"))
    found = coverage.groupBy("doc_id").agg(F.max((F.col("coverage") == "unsupported").cast("int")).alias("c"))
    return own.join(found, "doc_id", "left").select("doc_id", F.when((F.col("u") == 1) | (F.coalesce("c", F.lit(0)) == 1), "UNSUPPORTED").when(F.col("r") == 1, "NEEDS_REVIEW").otherwise("READY").alias("status"))


def source_coverage(objects: DataFrame, mapped: DataFrame) -> DataFrame:
    """Each object as mapped, dependency (of a mapped one, by `host`), layout_only (blank paragraph) or unsupported."""
    ids = mapped.select("doc_id", "object_id").distinct()
    rows = objects.join(ids.withColumn("_own", F.lit(True)), ["doc_id", "object_id"], "left")
    rows = rows.join(ids.withColumnRenamed("object_id", "host").withColumn("_host", F.lit(True)), ["doc_id", "host"], "left")
    label = F.when(F.col("_own").isNotNull(), "mapped").when(F.col("_host").isNotNull(), "dependency").when((F.col("kind") == "paragraph") & (F.trim("text") == ""), "layout_only").otherwise("unsupported")
    return rows.select("doc_id", "object_id", label.alias("coverage"))


def histogram(df: DataFrame, key: str, by: str = "doc_id") -> DataFrame:
    return df.groupBy(by, key).agg(F.count("*").alias("n"))


def repair_headings(items: DataFrame) -> DataFrame:
    """Where at least three items of one numbering shape are all headings and four fifths share a field, all get it."""
    group = W.partitionBy("doc_id", "shape")
    useful = ~F.col("shape").isin("none", "not_text")
    heading = (F.col("status") == "classified") & F.col("field_id").rlike(HEADING)
    rows = items.withColumn("_n", F.count("*").over(group)).withColumn("_ok", F.min(F.coalesce(heading, F.lit(False)).cast("int")).over(group) == 1)
    rows = rows.withColumn("_same", F.count("*").over(W.partitionBy("doc_id", "shape", "field_id")))
    rows = rows.withColumn("_top", F.max(F.struct("_same", "field_id")).over(group))
    repaired = useful & F.col("_ok") & (F.col("_n") >= 3) & (F.col("_top._same") / F.col("_n") >= 0.8) & (F.col("field_id") != F.col("_top.field_id"))
    return rows.select(*[c for c in items.columns if c != "field_id"], F.when(repaired, F.col("_top.field_id")).otherwise(F.col("field_id")).alias("field_id"), F.coalesce(repaired, F.lit(False)).alias("repaired"))


def bind_captions(items: DataFrame) -> DataFrame:
    """(doc_id, caption_id, target_id): each caption's nearest object of its field, at most two blocks away.

    Ties go by distance, then the object before, then distance in items. Blocks fall into buckets of three, of which a
    caption meets its own and both neighbours, so the band condition becomes an equal one.
    """
    rows = items.withColumn("_i", F.row_number().over(in_document()))
    captions = rows.where(F.col("field_id").endswith(".caption")).select("doc_id", F.col("object_id").alias("caption_id"), F.regexp_replace("field_id", r"\.caption$", "").alias("field_id"), F.col("block").alias("_b"), F.col("_i").alias("_ci"))
    captions = captions.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_b") / 3) + k for k in (-1, 0, 1)])))
    targets = rows.select("doc_id", "field_id", F.col("object_id").alias("target_id"), "block", "_i", F.floor(F.col("block") / 3).alias("_bucket"))
    away = F.abs(F.col("block") - F.col("_b"))
    pairs = captions.join(targets, ["doc_id", "field_id", "_bucket"]).where(away <= 2)
    best = W.partitionBy("doc_id", "caption_id").orderBy(away, F.when(F.col("_i") < F.col("_ci"), 0).otherwise(1), F.abs(F.col("_i") - F.col("_ci")))
    return pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("doc_id", "caption_id", "target_id")


def neighbours(items: DataFrame) -> DataFrame:
    """The nearest texts before and after each item that aren't blank."""
    said = F.when(F.trim("value") != "", F.col("value"))
    before = in_document().rowsBetween(W.unboundedPreceding, -1)
    after = in_document().rowsBetween(1, W.unboundedFollowing)
    return items.select("doc_id", "block", "inline", F.last(said, ignorenulls=True).over(before).alias("previous_text"), F.first(said, ignorenulls=True).over(after).alias("next_text"))


def assign_order(items: DataFrame) -> DataFrame:
    """Inline rank inside a block: structural items first, then by where the value stands in the block's text, field and id."""
    place = F.when(F.col("structural"), F.lit(0)).otherwise(F.lit(1))
    at = F.call_function("locate", F.col("value"), F.col("block_text"))
    order = W.partitionBy("doc_id", "block").orderBy(place, at, F.col("field_id").asc_nulls_first(), "object_id")
    return items.withColumn("inline", (F.row_number().over(order) - 1).cast("long"))


def unique_ids(df: DataFrame, base: str, *order: str) -> DataFrame:
    """Adds unique_id: a repeated base id gets #1, #2 and so on from its second row."""
    n = F.row_number().over(W.partitionBy(base).orderBy(*order)) - 1
    return df.withColumn("unique_id", F.when(n > 0, F.concat(F.col(base), F.lit("#"), n.cast("string"))).otherwise(F.col(base)))


def offsets(runs: DataFrame) -> DataFrame:
    """Running character offsets of runs in their block, and the section: it rises after a block that ends one."""
    past = W.partitionBy("doc_id", "block").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(past), F.lit(0))
    sections = W.partitionBy("doc_id").orderBy("block").rangeBetween(W.unboundedPreceding, -1)
    section = F.coalesce(F.sum(F.when((F.col("run") == 1) & F.col("ends_section"), 1).otherwise(0)).over(sections), F.lit(0))
    # sections first: what lies by document also lies by block, and only sizes have to move
    rows = runs.withColumn("_size", F.length("text")).withColumn("section", section)
    return rows.withColumn("start", start).withColumn("stop", F.col("start") + F.col("_size")).select(*runs.columns, "start", "stop", "section")


def toc(items: DataFrame) -> DataFrame:
    """(doc_id, outline): headings of levels one to three as an indented tree, in order."""
    return outline_tree(items.withColumn("level", F.regexp_extract("field_id", HEADING, 1).try_cast("int")))


def outline_tree(rows: DataFrame) -> DataFrame:
    """(doc_id, outline, entries) of rows(doc_id, block, inline, level, value): those of levels one to three as an indented tree, in order."""
    rows = rows.where("level between 1 and 3")
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "value")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "inline", line.alias("line")))), lambda x: x["line"]), "\n").alias("outline"), F.count("*").alias("entries"))


def plan_batches(items: DataFrame, most: int = 32, most_bytes: int = 24_000) -> DataFrame:
    """Adds batch (from 0): greedy in order, at most `most` items and `most_bytes` of text; a larger item stands alone.

    The rule depends on where the last batch ended, so it is a fold over each document's ordered sizes.
    """
    listed = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "inline", F.octet_length(F.coalesce("value", F.lit(""))).cast("long").alias("size")))).alias("rows"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"), F.array(F.lit(0)).alias("starts"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & ((a["n"] >= most) | (a["bytes"] + x["size"] > most_bytes))
        return F.struct((a["at"] + 1).alias("at"), F.when(full, F.lit(1).cast("long")).otherwise(a["n"] + 1).alias("n"), F.when(full, x["size"]).otherwise(a["bytes"] + x["size"]).alias("bytes"), F.when(full, F.array_append(a["starts"], a["at"])).otherwise(a["starts"]).alias("starts"))

    folded = listed.select("doc_id", "rows", F.aggregate("rows", start, step)["starts"].alias("starts"))
    stop = lambda i: F.coalesce(F.try_element_at("starts", i + 2), F.size("rows"))
    cuts = folded.select("doc_id", F.posexplode(F.transform("starts", lambda s, i: F.slice("rows", s + 1, stop(i) - s))).alias("batch", "part"))
    return cuts.select("doc_id", F.col("batch").cast("long").alias("batch"), F.inline("part")).select("doc_id", "block", "inline", "size", "batch")


def batch_context(batches: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, batch, primary, context): items of a batch, and those of up to k places around it."""
    rows = batches.withColumn("at", F.row_number().over(in_document()))
    spans = rows.groupBy("doc_id", "batch").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("primary"))
    size = rows.groupBy("doc_id").agg(F.max("at").alias("n"))
    context = F.least(F.col("low") - 1, F.lit(k)) + F.least(F.col("n") - F.col("high"), F.lit(k))
    return spans.join(size, "doc_id").select("doc_id", "batch", "primary", context.cast("long").alias("context"))


def merge_batches(results: DataFrame, relations: DataFrame, primary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations once each (the lowest batch wins), and distinct relations with one end in their batch's own items."""
    first = W.partitionBy("doc_id", "object_id").orderBy("batch")
    own = results.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    ends = primary.select("doc_id", "batch", F.col("object_id").alias("end")).distinct()
    tagged = relations.withColumn("end", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
    kept = tagged.join(ends, ["doc_id", "batch", "end"], "left_semi").select("doc_id", "source_id", "target_id", "relation").distinct()
    return own, kept


def dropped_relations(relations: DataFrame, primary: DataFrame) -> DataFrame:
    """(doc_id, batch, relations, dropped): a batch's relations, repeated ones too, and how many of them have no end in its own items."""
    own = primary.select("doc_id", "batch", F.col("object_id").alias("end")).distinct()
    numbered = relations.groupBy("doc_id", "batch", "source_id", "target_id", "relation").agg(F.count("*").alias("n"))
    ends = numbered.select("*", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("end")).join(own.withColumn("own", F.lit(True)), ["doc_id", "batch", "end"], "left")
    each = ends.groupBy("doc_id", "batch", "source_id", "target_id", "relation").agg(F.max("n").alias("n"), F.max("own").alias("own"))
    return each.groupBy("doc_id", "batch").agg(F.sum("n").alias("relations"), F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(0)).alias("dropped"))


def attach_to_host(children: DataFrame, hosts: DataFrame) -> DataFrame:
    """Each child with the host whose locator and a slash is its longest prefix; children without one are dropped.

    All prefixes of a child's locator are listed, so the join is an equal one.
    """
    parts = F.split("locator", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    listed = children.where(F.size(parts) > 1).select("*", F.explode(prefixes).alias("_prefix"))
    own = hosts.select("doc_id", F.col("locator").alias("host_locator"), F.col("locator").alias("_prefix"))
    nearest = W.partitionBy("doc_id", "locator").orderBy(F.length("host_locator").desc())
    return listed.join(own, ["doc_id", "_prefix"]).withColumn("_r", F.row_number().over(nearest)).where("_r = 1").drop("_r", "_prefix")


def inline_components(blocks: DataFrame) -> DataFrame:
    """Reading order inside a block: its complex objects first, then its text once if there is any."""
    parts = F.concat("children", F.when(F.trim("text") != "", F.array("text")).otherwise(F.array().cast("array<string>")))
    return blocks.select("doc_id", "block", F.posexplode(parts).alias("inline", "component"))


def assign_units(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Blocks with the unit whose range holds them; `units` counts how many do (0 is a gap, 2 an overlap)."""
    hit = blocks.join(units, (blocks.doc_id == units.unit_doc) & blocks.block.between(units.block_start, units.block_end), "left")
    return hit.groupBy(blocks.doc_id, blocks.block).agg(F.min("unit_id").alias("unit_id"), F.count("unit_id").alias("units"))


def lost_content(source: DataFrame, final: DataFrame) -> DataFrame:
    """How many of each document's source texts are missing from its final texts, repeats counted."""
    return source.select("doc_id", "text").exceptAll(final.select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("lost"))


def set_closure(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that only one of two declared sets has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.subtract(right).withColumn("code", F.lit("missing")).unionByName(right.subtract(left).withColumn("code", F.lit("extra")))


def apply_patches(objects: DataFrame, patches: DataFrame) -> DataFrame:
    """old becomes new only where it occurs as often as expected; texts leave as hashes."""
    n = ((F.length("text") - F.length(F.replace("text", "old", F.lit("")))) / F.length("old")).cast("long")
    rows = objects.join(patches, ["doc_id", "block"]).withColumn("found", n)
    fits = F.col("found") == F.col("expected")
    return rows.select("doc_id", "block", "found", F.when(fits, "applied").otherwise("count_differs").alias("code"), F.sha2("text", 256).alias("before_sha256"), F.when(fits, F.sha2(F.replace("text", "old", "new"), 256)).alias("after_sha256"))


def verify_hashes(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Content hashes against declared ones: verified, mismatch, missing or undeclared."""
    rows = found.select("name", F.col("sha256").alias("_f")).join(declared.select("name", F.col("sha256").alias("_d")), "name", "full")
    return rows.select("name", F.when(F.col("_f").isNull(), "missing").when(F.col("_d").isNull(), "undeclared").when(F.col("_f") == F.col("_d"), "verified").otherwise("mismatch").alias("status"))


def audit_presence(placed: DataFrame, final: DataFrame, norm) -> DataFrame:
    """Placed texts whose comparable form isn't in their final document's."""
    whole = final.select("doc_id", norm(F.col("final_text")).alias("_final"))  # once a document, not for each of its texts
    own = placed.select("doc_id", "block", norm(F.col("text")).alias("_text"))
    return own.join(whole, "doc_id").where(~F.col("_final").contains(F.col("_text"))).select("doc_id", "block")


#: What an audit counts besides texts; fixed values.
COMPLEX = ("images", "equations", "tables")


def audit_shortfalls(selected: DataFrame, final: DataFrame) -> DataFrame:
    """(doc_id, missing_images, missing_equations, missing_tables, missing_complex): by how much a final document has fewer than were selected for it.

    Both have doc_id and a count of each kind; a document that isn't there, or a null, counts as none.
    """
    count = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0)).cast("long")
    rows = selected.alias("a").join(final.alias("b"), "doc_id", "left")
    short = [F.greatest(F.lit(0).cast("long"), count("a", c) - count("b", c)).alias(f"missing_{c}") for c in COMPLEX]
    return rows.select("doc_id", *short).withColumn("missing_complex", F.expr(" + ".join(f"missing_{c}" for c in COMPLEX)))


def leak_scan(canaries: DataFrame, surfaces: DataFrame, names: list[str]) -> DataFrame:
    """How many texts of each surface hold a protected string, anywhere in it; strings without hits keep a zero.

    names: the surfaces. Empty strings are in every text; null strings and texts in none.
    """
    own = canaries.select("canary_id", F.col("text").alias("canary"))
    counts = held_strings(surfaces.select("surface", "text"), own, string_col="canary").groupBy("canary", "surface").agg(F.count("*").alias("hits"))
    counts = own.join(counts, "canary").select("canary_id", "surface", "hits")
    every = own.select("canary_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("surface"))
    return every.join(counts, ["canary_id", "surface"], "left").select("canary_id", "surface", F.coalesce("hits", F.lit(0)).alias("hits"))
