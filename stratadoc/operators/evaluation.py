"""Extracted content against accepted reference data: coverage, fields, values, grouping, order, hierarchy, provenance."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut
from .patterns import held_strings

def first_per(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in source order, so that a join never multiplies rows."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def digest(text: Column) -> Column:
    """A text's digest in 16 bytes, null for null: what moves of texts that are only held equal or not."""
    return F.unhex(F.md5(text))


def known_by(df: DataFrame, name: str = "object_id") -> DataFrame:
    """df with _id, the digest of a name: rows meet by it, so that names move only where they are asked for."""
    return df.withColumn("_id", digest(F.col(name).cast("string")))


def compare_coverage(actual: DataFrame, gold: DataFrame) -> DataFrame:
    """Per document: gold sources missing, and actual ones beyond gold, split by whether all their items are layout without a field."""
    a = known_by(actual).groupBy("doc_id", "_id").agg(F.bool_and((F.col("status") == "layout_only") & F.col("field_id").isNull()).alias("excluded"))
    g = known_by(gold).select("doc_id", "_id", F.lit(True).alias("in_gold")).distinct()
    rows = a.join(g, ["doc_id", "_id"], "full")
    return rows.groupBy("doc_id").agg(F.count_if(F.col("excluded").isNull()).alias("missing"), F.count_if(F.col("in_gold").isNull() & F.col("excluded")).alias("correctly_excluded"), F.count_if(F.col("in_gold").isNull() & ~F.col("excluded")).alias("unexpected"))


def compare_fields(actual: DataFrame, gold: DataFrame) -> DataFrame:
    """Each gold (source, field) as exact, mismatch or missing."""
    a = first_per(known_by(actual), ["doc_id", "_id"], "block").select("doc_id", "_id", F.col("field_id").alias("actual_field"), F.lit(True).alias("found"))
    rows = known_by(gold).join(a, ["doc_id", "_id"], "left")
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("actual_field").eqNullSafe(F.col("field_id")), "exact").otherwise("mismatch")
    return rows.select("doc_id", "object_id", "field_id", verdict.alias("result"))


def field_deltas(actual: DataFrame, gold: DataFrame) -> DataFrame:
    a = actual.where("field_id is not null").groupBy("doc_id", "field_id").agg(F.count("*").alias("actual"))
    g = gold.groupBy("doc_id", "field_id").agg(F.count("*").alias("gold"))
    rows = a.join(g, ["doc_id", "field_id"], "full").na.fill(0, ["actual", "gold"])
    return rows.withColumn("delta", F.col("actual") - F.col("gold"))


def compare_values(actual: DataFrame, gold: DataFrame, form) -> DataFrame:
    """Gold values by semantic key (source and field): exact, mismatch, or not comparable where the key is absent.

    form: the comparable form of a value; null equals null alone. Digests of forms move, not values.
    """
    said = lambda df: known_by(df).withColumn("value", digest(form(F.col("value"))))
    keys = ["doc_id", "_id", "field_id"]
    a = first_per(said(actual.where("field_id is not null")), keys, "block").select(*keys, F.col("value").alias("actual_value"), F.lit(True).alias("found"))
    rows = said(gold).join(a, keys, "left")
    return rows.select("doc_id", "object_id", F.when(F.col("found").isNull(), "no_key").when(F.col("value").eqNullSafe(F.col("actual_value")), "exact").otherwise("mismatch").alias("result"))


def compare_item_values(actual: DataFrame, gold: DataFrame, form) -> DataFrame:
    """(doc_id, item_id, object_id, result) of gold items' values: exact or mismatch, for whole groups (object_id null) or by source.

    actual(doc_id, seq, sources, field_id, value): items with their ordered sources. gold(doc_id, item_id, field_id, value,
    pieces): pieces are the sources in order, structs (object_id, text). A gold item whose sources and field an actual one
    has as they are is compared as a whole. Any other is compared source by source, where an actual item of the field has
    the source, the first by seq if several do: with the source's own text if the pieces' texts joined equal the item's
    value, else with the whole value. What isn't there isn't compared. form: the comparable form of a value; null equals
    null alone. Digests of forms and of keys move, not values.
    """
    keyed = lambda sources: F.when(F.size(sources) > 0, digest(F.to_json(F.struct(F.lit(0).alias("v"), sources.alias("s"), F.col("field_id").alias("f"))))).alias("_key")
    said = digest(form(F.col("value")))
    groups = first_per(actual.select("doc_id", "seq", keyed(F.col("sources")), said.alias("_group")).where("_key is not null"), ["doc_id", "_key"], "seq").select("doc_id", "_key", "_group", F.lit(True).alias("_whole"))
    joined = F.array_join(F.transform("pieces", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    own = gold.select("doc_id", "item_id", "field_id", "pieces", keyed(F.transform("pieces", lambda x: x["object_id"])), said.alias("_value"), digest(form(joined)).alias("_joined"))
    pieces = lambda expected: F.transform("pieces", lambda x: F.struct(x["object_id"].alias("object_id"), expected(x).alias("expected")))
    pieces = F.when(F.col("_value") == F.col("_joined"), pieces(lambda x: digest(form(x["text"])))).otherwise(pieces(lambda x: F.col("_value")))
    own = own.select("doc_id", "item_id", "field_id", "_key", "_value", pieces.alias("_pieces"))
    own = own.join(groups, ["doc_id", "_key"], "left")
    judged = lambda observed, expected: F.when(F.col(observed).eqNullSafe(F.col(expected)), "exact").otherwise("mismatch").alias("result")
    whole = own.where("_whole").select("doc_id", "item_id", F.lit(None).cast("string").alias("object_id"), judged("_group", "_value"))
    pieces = own.where("_whole is null").select("doc_id", "item_id", "field_id", F.inline("_pieces"))
    found = actual.select("doc_id", "seq", "field_id", said.alias("_observed"), F.explode("sources").alias("object_id")).where("field_id is not null")
    rows = pieces.join(first_per(found, ["doc_id", "object_id", "field_id"], "seq").drop("seq"), ["doc_id", "object_id", "field_id"])
    return whole.unionByName(rows.select("doc_id", "item_id", "object_id", judged("_observed", "expected")))


def compare_grouping(actual: DataFrame, gold: DataFrame) -> DataFrame:
    """Bindings (ordered sources, field or status) of both sides: exact, missing, unexpected; `copies` tells duplicates."""
    count = lambda df, n: known_by(df, "binding").groupBy("doc_id", "_id").agg(F.count("*").alias(n), F.first("binding").alias(f"{n}_binding"))
    rows = count(actual, "a").join(count(gold, "g"), ["doc_id", "_id"], "full")
    return rows.select("doc_id", F.coalesce("a_binding", "g_binding").alias("binding"), F.when(F.col("a").isNull(), "missing").when(F.col("g").isNull(), "unexpected").otherwise("exact").alias("result"), F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("g", F.lit(0))).alias("copies"))


def binding(ids: Column, field: Column, status: Column) -> Column:
    return F.concat(F.array_join(ids, "+"), F.lit("|"), F.coalesce(field, F.concat(F.lit("<"), status, F.lit(">"))))


def compare_order(actual: DataFrame, gold: DataFrame) -> DataFrame:
    """Per document: equal sequences of keys, the first place that differs, and whether common keys keep their order."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    numbered = lambda df, side: known_by(df, "key").withColumn("n", place).select("doc_id", "n", F.col("_id").alias(side))
    a, g = numbered(actual, "a"), numbered(gold, "g")
    both = a.join(g, ["doc_id", "n"], "full").groupBy("doc_id").agg(F.bool_and(F.col("a").eqNullSafe(F.col("g"))).alias("equal"), F.min(F.when(~F.col("a").eqNullSafe(F.col("g")), F.col("n"))).alias("first_mismatch"))
    common = a.select("doc_id", F.col("a").alias("key"), F.col("n").alias("an")).join(g.select("doc_id", F.col("g").alias("key"), F.col("n").alias("gn")), ["doc_id", "key"])
    before = F.lag("gn").over(W.partitionBy("doc_id").orderBy("an"))
    kept = common.withColumn("_ok", F.coalesce(before < F.col("gn"), F.lit(True))).groupBy("doc_id").agg(F.bool_and("_ok").alias("relative_order"))
    return both.join(kept, "doc_id", "left")


def compare_hierarchy(actual: DataFrame, gold: DataFrame, relations: DataFrame) -> DataFrame:
    """Children of both sides by parent: direct, relation (through a caption or note), root, or mismatch."""
    of = lambda name: digest(F.col(name).cast("string"))
    a = known_by(actual).select("doc_id", "_id", of("parent_id").alias("actual_parent"))
    via = known_by(relations, "caption_id").select("doc_id", "_id", of("target_id").alias("expected_parent"), F.lit(True).alias("via")).distinct()
    rows = known_by(gold).select("doc_id", "object_id", "_id", of("parent_id").alias("expected_parent")).join(a, ["doc_id", "_id"]).join(via, ["doc_id", "_id", "expected_parent"], "left")
    how = F.when(F.col("expected_parent").isNull() & F.col("actual_parent").isNull(), "root").when(F.col("expected_parent") == F.col("actual_parent"), "direct").when(F.col("via"), "relation").otherwise("mismatch")
    return rows.select("doc_id", "object_id", how.alias("result"))


def compare_provenance(heads: DataFrame, actual: DataFrame, inventory: DataFrame, refs: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, seven checks, mismatches), and a row (doc_id, object_id, present, document, locator) for each gold reference that doesn't hold.

    heads: (doc_id, hashes and registry identities of the three sides). actual and inventory: items (doc_id, pos, item_id,
    block, inline, object_ids, locators), whose lists must agree place by place. refs: the gold's (doc_id, object_id,
    document_sha256, locator), nulls unchecked; objects: (doc_id, object_id, locators), all names of each.
    """
    whole = lambda *names: digest(F.to_json(F.struct(*names)))
    side = lambda df, n: df.select("doc_id", "pos", whole("item_id").alias(f"{n}_id"), F.struct("block", "inline").alias(f"{n}_order"), whole("item_id", "object_ids", "locators", "block", "inline").alias(f"{n}_bound"))
    both = side(actual, "a").join(side(inventory, "i"), ["doc_id", "pos"], "full")
    agree = lambda n: F.bool_and(F.col(f"a_{n}").eqNullSafe(F.col(f"i_{n}")))
    places = both.groupBy("doc_id").agg(agree("id").alias("item_ids"), agree("order").alias("orders"), agree("bound").alias("bindings"))
    own = known_by(objects).select("doc_id", "_id", "locators", F.lit(True).alias("there"))
    found = known_by(refs).join(own, ["doc_id", "_id"], "left").join(heads.select("doc_id", "inventory_sha256"), "doc_id", "left")
    present = F.coalesce("there", F.lit(False))
    document = present & (F.col("document_sha256").isNull() | F.coalesce(F.col("document_sha256") == F.col("inventory_sha256"), F.lit(False)))
    locator = present & (F.col("locator").isNull() | F.coalesce(F.array_contains("locators", F.col("locator")), F.lit(False)))
    bad = found.select("doc_id", "object_id", present.alias("present"), document.alias("document"), locator.alias("located")).where("not (present and document and located)")
    rows = heads.join(places, "doc_id", "left").join(bad.groupBy("doc_id").agg(F.count("*").alias("mismatches")), "doc_id", "left")
    same = lambda *c: F.coalesce(F.col(c[0]) == F.col(c[1]), F.lit(False))
    checks = rows.select(
        "doc_id",
        (same("actual_sha256", "inventory_sha256") & same("inventory_sha256", "gold_sha256")).alias("source"),
        same("actual_registry", "gold_registry").alias("registry_identity"),
        same("actual_registry_sha256", "gold_registry_sha256").alias("registry_hash"),
        *[F.coalesce(c, F.lit(True)).alias(c) for c in ("item_ids", "orders", "bindings")],
        F.col("mismatches").isNull().alias("source_references"),
        F.coalesce("mismatches", F.lit(0)).alias("mismatches"),
    )
    return checks, bad


#: The paragraph or table of the body that a locator begins with; fixed pattern.
HOST = r"^(/body/p\[@paraId=[^]]+\]|/body/tbl\[[0-9]+\])(/|$)"


def locator_aliases(objects: DataFrame) -> DataFrame:
    """(doc_id, object_id, locator): each object's locator, and host/image[n] of pictures and shapes, the n-th of their host by seq."""
    own = objects.where("locator is not null").select("doc_id", "object_id", "locator")
    if "kind" not in objects.columns:
        return own.distinct()
    pictures = objects.where("kind in ('picture', 'shape')").withColumn("_host", F.regexp_extract("locator", HOST, 1)).where("_host <> ''")
    n = F.row_number().over(W.partitionBy("doc_id", "_host").orderBy("seq", "object_id"))
    images = pictures.select("doc_id", "object_id", F.concat("_host", F.lit("/image["), n.cast("string"), F.lit("]")).alias("locator"))
    return own.unionByName(images).distinct()


def crosswalk(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Gold references by id, else by a locator that names exactly one object; the rest say why not.

    objects(doc_id, object_id, locator[, kind, seq]): with kinds, pictures have their alias in their host too.
    """
    direct = refs.join(objects.select("doc_id", "object_id", F.col("object_id").alias("by_id")).distinct(), ["doc_id", "object_id"], "left")
    aliases = locator_aliases(objects).groupBy("doc_id", "locator").agg(F.count("*").alias("n"), F.min("object_id").alias("by_locator"))
    rows = direct.join(aliases, ["doc_id", "locator"], "left")
    return rows.select("doc_id", "object_id", F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_locator"))).alias("resolved"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("n") == 1, "locator").when(F.col("n") > 1, "locator_ambiguous").otherwise("locator_missing").alias("how"))


def content_report(parts: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, blockers, status): one boolean per dimension and document, names of failed ones in order."""
    out = None
    for name, df in parts.items():
        own = df.select("doc_id", F.col("passed").alias(name))
        out = own if out is None else out.join(own, "doc_id", "full")
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(n), F.lit(True)), F.lit(n)) for n in parts]))
    return out.select("doc_id", failed.alias("blockers"), F.when(F.size(failed) == 0, "PASS").otherwise("FAIL").alias("status"))


#: What is measured of a document in each of the eight dimensions, and the codes of a report's blockers in order with the measures behind them; fixed values.
DIMENSIONS = {
    "provenance": ("provenance_mismatch",),
    "source_coverage": ("missing_mapped_source", "unexpected_actual_source", "incorrectly_handled_excluded"),
    "field_semantics": ("missing_source_field", "field_mismatch", "field_count_difference"),
    "value_fidelity": ("value_mismatch",),
    "semantic_grouping": ("missing_binding_group", "unexpected_binding_group", "duplicate_binding"),
    "content_order": ("sequence_mismatch",),
    "hierarchy": ("parent_mismatch",),
    "live_run_evidence": ("evidence_incomplete",),
}
BLOCKERS = {
    "provenance_mismatch": ("provenance_mismatch",),
    "actual_not_ready": ("not_ready",),
    "duplicate_source_binding": ("duplicate_binding",),
    "source_coverage_mismatch": ("missing_mapped_source", "unexpected_actual_source"),
    "excluded_source_misclassified": ("incorrectly_handled_excluded",),
    "field_semantics_mismatch": ("missing_source_field", "field_mismatch", "field_count_difference"),
    "observed_value_mismatch": ("value_mismatch",),
    "semantic_item_grouping_mismatch": ("missing_binding_group", "unexpected_binding_group"),
    "content_order_mismatch": ("sequence_mismatch",),
    "hierarchy_mismatch": ("parent_mismatch",),
    "live_api_evidence_incomplete": ("evidence_incomplete",),
}


def dimension_report(documents: DataFrame, measures: DataFrame) -> DataFrame:
    """(doc_id, status, blockers, one column PASS or FAIL for each dimension) of each of the documents(doc_id).

    measures(doc_id, measure, n): what comparisons found, in any number of rows; a measure that isn't there is 0. All of
    them are summed in one grouping. Unknown measures and documents are passed over.
    """
    names = sorted({m for group in (*DIMENSIONS.values(), *BLOCKERS.values()) for m in group})
    found = measures.groupBy("doc_id").agg(*[(F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)) > 0).alias(f"_{m}") for m in names])
    rows = documents.select("doc_id").join(found, "doc_id", "left")
    hit = lambda group: functools.reduce(Column.__or__, [F.coalesce(F.col(f"_{m}"), F.lit(False)) for m in group])
    blockers = F.array_compact(F.array(*[F.when(hit(group), F.lit(code)) for code, group in BLOCKERS.items()]))
    return rows.select("doc_id", F.when(F.size(blockers) == 0, "PASS").otherwise("FAIL").alias("status"), blockers.alias("blockers"), *[F.when(hit(group), "FAIL").otherwise("PASS").alias(d) for d, group in DIMENSIONS.items()])


def guard_binding(left: DataFrame, right: DataFrame, key: str, snapshot: str) -> DataFrame:
    """Rows that would join, and why they may not: their snapshots must be the same."""
    r = right.select(key, F.col(snapshot).alias("_s"))
    rows = left.join(r, key, "left")
    return rows.withColumn("code", F.when(F.col("_s").isNull(), "absent").when(F.col("_s") != F.col(snapshot), "stale").otherwise("current")).drop("_s")


def integrity(items: DataFrame, registry: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_id, object_id, code): unregistered fields, and items whose object or parent is gone."""
    named = items.where("field_id is not null").join(registry.select("field_id"), "field_id", "left_anti").select("doc_id", "object_id", F.lit("field_unregistered").alias("code"))
    stale = items.join(objects.select("doc_id", "object_id"), ["doc_id", "object_id"], "left_anti").select("doc_id", "object_id", F.lit("source_stale").alias("code"))
    parents = items.where("parent_id is not null").join(objects.select("doc_id", F.col("object_id").alias("parent_id")), ["doc_id", "parent_id"], "left_anti").select("doc_id", "object_id", F.lit("parent_stale").alias("code"))
    return named.unionByName(stale).unionByName(parents)


def place(slots: DataFrame, items: DataFrame) -> DataFrame:
    """Each slot of a document with the texts of its field in source order, and whether it is filled."""
    rows = slots.join(items.where("status = 'classified'").select("doc_id", "field_id", "block", "value"), ["doc_id", "field_id"], "left")
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "value")))), lambda x: x["value"])
    return rows.groupBy("doc_id", "slot_id", "field_id", "required").agg(F.count("block").alias("n"), F.array_join(texts, "\n").alias("text")).withColumn("status", F.when(F.col("n") > 0, "filled").otherwise("missing"))


#: Prefixes of the fields of body items, and the codes of what leaves a placement partial, in order; fixed values.
BODY = ("body.", "conclusion.")
PARTIAL = ("template_fill_contract_not_human_accepted", "required_slots_missing", "generated_regions_not_materialized")


def build_placement(slots: DataFrame, items: DataFrame, registry: DataFrame, body_fields: list[str]) -> DataFrame:
    """(doc_id, slot_id, field_id, tag, required, status, action, value, sources): what each slot of a document is filled with.

    slots(doc_id, slot_no, slot_id, field_id, tag, required), items(doc_id, block, inline, field_id, value, object_id),
    registry(field_id, content_type). A slot of a text field takes its items' values in source order, one to a line; one of
    another type takes their blocks, as ordered different sources. Slots of body_fields are filled by the body as a whole:
    one more row, slot.body.aggregate, puts all items of BODY fields at the first such slot of the document. It has no tag
    where a document has body items and no such slot.
    """
    ordered = F.array_sort(F.collect_list(F.struct("block", "inline", "object_id", "value")))
    texts = lambda c: F.filter(F.transform(c, lambda x: x["value"]), lambda v: v.isNotNull())
    ids = lambda c: F.array_distinct(F.transform(c, lambda x: x["object_id"]))
    own = items.where("field_id is not null")
    of_field = own.groupBy("doc_id", "field_id").agg(ordered.alias("_i"))
    rows = slots.join(of_field, ["doc_id", "field_id"], "left").join(registry.select("field_id", "content_type").dropDuplicates(["field_id"]), "field_id", "left")
    body, there = F.col("field_id").isin(*body_fields), F.col("_i").isNotNull()
    status = F.when(~there, "missing").when(body, "filled_by_body_items").otherwise("filled")
    plain = F.coalesce(F.col("content_type") == "text", F.lit(False))
    action = F.when(there & ~body, F.when(plain, "replace_text_content_control").otherwise("replace_block_content_control"))
    placed = rows.select("doc_id", "slot_id", "field_id", "tag", "required", status.alias("status"), action.alias("action"), F.when(there & ~body & plain, F.array_join(texts(F.col("_i")), "\n")).alias("value"), F.when(there & ~body, ids(F.col("_i"))).alias("sources"))
    is_body = F.col("field_id").startswith(BODY[0]) | F.col("field_id").startswith(BODY[1])
    whole = own.where(is_body).groupBy("doc_id").agg(ordered.alias("_i"))
    anchor = slots.where(body).groupBy("doc_id").agg(F.min_by("tag", "slot_no").alias("tag"))
    one = whole.join(anchor, "doc_id", "left").select("doc_id", F.lit("slot.body.aggregate").alias("slot_id"), F.lit("body.ordered_items").alias("field_id"), "tag", F.lit(False).alias("required"), F.when(F.col("tag").isNotNull(), "filled").otherwise("missing").alias("status"), F.lit("replace_block_content_control").alias("action"), F.lit(None).cast("string").alias("value"), ids(F.col("_i")).alias("sources"))
    return placed.unionByName(one)


def placement_report(placed: DataFrame, regions: DataFrame, contracts: DataFrame) -> DataFrame:
    """(doc_id, status, missing_required, unresolved_regions, reasons) of each of the contracts(doc_id, status): PARTIAL for any of the reasons of PARTIAL.

    regions(doc_id, region_id, required): required ones are generated later and so unresolved.
    """
    missing = placed.where(F.col("required") & (F.col("status") == "missing")).groupBy("doc_id").agg(F.array_sort(F.collect_set("slot_id")).alias("missing_required"))
    open_ = regions.where("required").groupBy("doc_id").agg(F.array_sort(F.collect_set("region_id")).alias("unresolved_regions"))
    rows = contracts.select("doc_id", (~F.col("status").eqNullSafe(F.lit("accepted"))).alias("_open")).join(missing, "doc_id", "left").join(open_, "doc_id", "left")
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in zip(PARTIAL, (F.col("_open"), F.col("missing_required").isNotNull(), F.col("unresolved_regions").isNotNull()), strict=True)]))
    none = F.array().cast("array<string>")
    return rows.select("doc_id", F.when(F.size(reasons) == 0, "COMPLETE").otherwise("PARTIAL").alias("status"), F.coalesce("missing_required", none).alias("missing_required"), F.coalesce("unresolved_regions", none).alias("unresolved_regions"), reasons.alias("reasons"))


def placement_status(placed: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("required") & (F.col("status") == "missing"))
    return placed.groupBy("doc_id").agg(missing.alias("missing_required"), F.when(missing > 0, "PARTIAL").otherwise("COMPLETE").alias("status"))


def align_slots(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """Gold slots by id, else by tag and part if that names one; several are ambiguous."""
    by_id = actual.groupBy("pair_id", "slot_id").agg(F.count("*").alias("n_id"))
    by_tag = actual.groupBy("pair_id", "tag", "part").agg(F.count("*").alias("n_tag"), F.min("slot_id").alias("tag_slot"))
    rows = gold.join(by_id, ["pair_id", "slot_id"], "left").join(by_tag, ["pair_id", "tag", "part"], "left")
    status = F.when(F.coalesce("n_id", "n_tag").isNull(), "MISSING").when(F.coalesce("n_id", "n_tag") > 1, "AMBIGUOUS").otherwise("MATCHED")
    return rows.select("pair_id", "slot_id", F.when(status == "MATCHED", F.when(F.col("n_id") == 1, F.col("slot_id")).otherwise(F.col("tag_slot"))).alias("actual_slot"), status.alias("status"))


def check_markers(declared: DataFrame, present: DataFrame) -> DataFrame:
    """Declared tags against present ones: missing, undeclared, repeated or fine."""
    rows = declared.groupBy("pair_id", "tag").agg(F.count("*").alias("d")).join(present.groupBy("pair_id", "tag").agg(F.count("*").alias("p")), ["pair_id", "tag"], "full")
    return rows.select("pair_id", "tag", F.when(F.col("p").isNull(), "missing").when(F.col("d").isNull(), "undeclared").when(F.col("p") > 1, "repeated").otherwise("fine").alias("code"))


def locate_paragraphs(paragraphs: DataFrame, locators: DataFrame) -> DataFrame:
    """Paragraphs that meet all given coordinates of a locator; with `occurrence`, the n-th of them."""
    fits = (F.col("l_level").isNull() | (F.col("l_level") == F.col("level"))) & (F.col("anchor").isNull() | F.col("text").contains(F.col("anchor")))
    rows = paragraphs.join(locators, "doc_id").where(fits)
    n = F.row_number().over(W.partitionBy("locator_id").orderBy("block"))
    return rows.withColumn("_n", n).where("occurrence is null or occurrence = _n").drop("_n")


def residue_scan(regions: DataFrame, docs: DataFrame) -> DataFrame:
    """Declared forbidden texts of a document's source: PASS, FAIL, or UNKNOWN without a text.

    All different forbidden texts are looked for at once; what is joined by source are documents without their texts.
    """
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("_digest"))
    found = held_strings(keyed.select("doc_id", "_digest", "text"), regions, string_col="forbidden").distinct().withColumn("_held", F.lit(True))
    rows = keyed.drop("text").join(regions.select("region_id", "source", "forbidden"), "source").join(found, ["doc_id", "_digest", "forbidden"], "left")
    return rows.select("doc_id", "region_id", F.when(F.col("forbidden").isNull(), "UNKNOWN").when(F.col("_held"), "FAIL").otherwise("PASS").alias("status"))


#: The keys of a registry's field that are kept; fixed values.
FIELD = "field_id string, label string, meaning string, content_type string, cardinality string, language string, parent_field_id string, notes string, value_sources array<string>, student_extraction_policy string, normalization map<string,string>"


def load_registry(rows: DataFrame) -> DataFrame:
    """Fields of a registry from rows with a JSON text each; unknown keys go, other columns stay."""
    return rows.withColumn("_field", F.from_json("json", FIELD)).select(*[c for c in rows.columns if c != "json"], "_field.*")


def check_registry(registry: DataFrame) -> DataFrame:
    """(field_id, code): missing ids, duplicates, unknown parents, empty sources and policies outside the list."""
    blank = registry.where("field_id is null").select("field_id", F.lit("field_id_missing").alias("code"))
    twice = registry.where("field_id is not null").groupBy("field_id").agg(F.count("*").alias("n")).where("n > 1").select("field_id", F.lit("field_id_duplicate").alias("code"))
    known = registry.where("field_id is not null").select(F.col("field_id").alias("parent_field_id")).distinct()
    parents = registry.where("parent_field_id is not null").join(known, "parent_field_id", "left_anti").select("field_id", F.lit("parent_unknown").alias("code"))
    empty = (F.size("value_sources") == 0) | F.exists("value_sources", lambda x: F.coalesce(x, F.lit("")) == "")
    sources = registry.where(empty).select("field_id", F.lit("value_sources_empty").alias("code"))
    policy = registry.where("student_extraction_policy not in ('required', 'optional', 'not_applicable')").select("field_id", F.lit("policy_invalid").alias("code"))
    return blank.unionByName(twice).unionByName(parents).unionByName(sources).unionByName(policy)


#: What a query scores where a field's id or label is the query, holds it, its meaning or its notes hold it; and what a term scores; fixed values.
WHOLE, HELD, TERM = 1000, {"field_id": 800, "label": 800, "meaning": 500, "notes": 200}, {"field_id": 110, "label": 90, "meaning": 40, "notes": 20}


def best(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of each key with the highest score, first by seq among equals; ranked in buckets first, so a frequent key is no single task."""
    order = [F.desc("score"), F.col("seq")]
    near = rows.withColumn("_r", F.row_number().over(W.partitionBy(key, F.pmod(F.xxhash64("seq"), F.lit(64))).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
    return near.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def search_registry(queries: DataFrame, registry: DataFrame, norm, k: int = 5) -> DataFrame:
    """(query_id, field_id, score, rank): the k best fields for queries(query_id, query, terms) in a registry(seq, field_id, label, meaning, notes), ties by seq.

    A query scores 1000 where id or label is the query, 800 where they hold it, 500 where the meaning does, 200 where the
    notes do; else each of its terms scores by the first of id, label, meaning and notes that holds it. norm: the
    comparable form of texts. Empty queries find nothing, empty terms count for nothing.

    An index has for each different query and term the fields that hold it. A query's k-th best score is bounded from
    below by the best few fields of its whole and of each term alone. Terms with the most fields, whose greatest scores
    together are below that bound, can't bring in a field of their own: only those of the other terms are candidates, and
    are looked up in the index for all terms. So a term that every field holds costs its best k fields alone.
    """
    asked = queries.select("query_id", norm(F.col("query")).alias("q"), F.transform("terms", norm).alias("terms")).where("q <> ''")
    if "notes" not in registry.columns:
        registry = registry.withColumn("notes", F.lit(None).cast("string"))
    parts = registry.select("seq", F.explode(F.array(*[F.struct(F.lit(c).alias("part"), norm(F.col(c)).alias("text")) for c in HELD])).alias("p")).select("seq", "p.part", "p.text").where("text is not null")
    wanted = asked.select("query_id", F.explode("terms").alias("string")).where("string <> ''").groupBy("query_id", "string").agg(F.count("*").alias("times"))
    strings = asked.select(F.col("q").alias("string")).unionByName(wanted.select("string"))
    of = lambda scores: F.create_map(*[F.lit(x) for item in scores.items() for x in item])[F.col("part")]
    held = held_strings(parts.withColumn("size", F.char_length("text")), strings)
    same = F.when((F.col("size") == F.char_length("string")) & F.col("part").isin("field_id", "label"), WHOLE)
    index = cut(held.groupBy("string", "seq").agg(F.max(F.coalesce(same, of(HELD))).cast("long").alias("whole"), F.max(of(TERM)).cast("long").alias("term")))
    whole = asked.select("query_id", F.col("q").alias("string"))
    few = best(index.withColumn("score", F.col("term")), "string", k).select("string", "seq", "term")
    first = best(index.withColumn("score", F.col("whole")), "string", k).select("string", "seq", "whole")
    held_whole = lambda rows: rows.join(whole, "query_id", "left").join(index.select("string", "seq", "whole"), ["string", "seq"], "left").select("query_id", "seq", F.coalesce("whole", "score").alias("score"))
    by_whole = cut(whole.join(first, "string").select("query_id", "seq", F.col("whole").alias("score")))
    some = wanted.join(few, "string").groupBy("query_id", "seq").agg(F.sum(F.col("term") * F.col("times")).alias("score"))
    least = best(held_whole(some).unionByName(by_whole).distinct(), "query_id", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    sizes = index.groupBy("string").agg(F.count("*").alias("n"), F.max("term").alias("most"))
    upto = F.sum(F.col("most") * F.col("times")).over(W.partitionBy("query_id").orderBy(F.desc("n"), "string").rowsBetween(W.unboundedPreceding, 0))
    leading = wanted.join(sizes, "string").withColumn("upto", upto).join(least, "query_id", "left").where("least is null or upto >= least").select("query_id", "string")
    candidates = leading.join(index.select("string", "seq"), "string").select("query_id", "seq").distinct()
    scored = candidates.join(wanted, "query_id").join(index.select("string", "seq", "term"), ["string", "seq"]).groupBy("query_id", "seq").agg(F.sum(F.col("term") * F.col("times")).alias("score"))
    ranked = best(held_whole(scored).unionByName(by_whole).distinct(), "query_id", k)
    return ranked.join(registry.select("seq", "field_id"), "seq").select("query_id", "field_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))
