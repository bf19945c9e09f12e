"""Evaluating declared slots and protected regions of two versions: one assertion row for each check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .alignment import styles_differ

#: Codes of failures, and dimensions that a slot without a partner fails; fixed values.
MISSING_TEXT, MOVED, BROKEN_OBJECT = "required_protected_content_missing_or_changed", "wrong_structural_location", "required_protected_object_missing_or_broken"
MISMATCH = "template_contract_marker_mismatch"
PREREQUISITES = ("slot.location_boundary", "slot.field_mapping", "slot.value_style")
COORDINATES = ("section", "paragraph", "table_index", "row", "cell")


def fits(wanted: Column, given: Column) -> Column:
    return wanted.isNull() | (wanted == given)


#: What an evaluation asks of a slot on each side besides its keys; fixed values.
GOLD_SLOT, ACTUAL_SLOT = ("required", "field_id", "style"), ("slot_id", "field_id", "content_type", "style")


def boundary(slot: Column, control: Column, text: Column) -> Column:
    """Declared and physical span, and the gaps to the last left anchor before it and the first right anchor after it."""
    left, right = slot["left_anchor"], slot["right_anchor"]
    head = F.substring(text, F.lit(1), control["start"] + 1)
    back = F.position(F.reverse(left), F.reverse(head))
    ahead = F.position(right, text, control["stop"] + 1)
    gaps = F.when(back > 0, control["start"] - F.length(head) + back - 1), F.when(ahead > 0, ahead - 1 - control["stop"])
    return F.struct(slot["start"].alias("declared_start"), slot["stop"].alias("declared_stop"), control["start"].alias("start"), control["stop"].alias("stop"), gaps[0].alias("left_gap"), gaps[1].alias("right_gap"))


def marker_differs(style: Column, control: Column) -> Column:
    """A placeholder's colour doesn't count."""
    named = F.when(control["placeholder"], F.map_filter(style, lambda k, _: k != "font.color")).otherwise(style)
    return styles_differ(named, control["style"])


def controls_of(slots: DataFrame, controls: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair_id, slot_id, n, control): how many controls each slot's locator names, and the first: where it is, its alias, the slot's boundary there and whether its style is another (marker).

    A locator gives story and part, and may give tag, paragraph and occurrence. Controls meet their texts before they
    meet slots, so that neither texts nor whole slots move on.
    """
    own = slots.select("pair_id", "slot_id", "story", "part", "occurrence", *[F.col(c).alias(f"_{c}") for c in ("tag", "paragraph")], F.struct("start", "stop", "left_anchor", "right_anchor", "style").alias("_slot"))
    given = controls.join(texts.select("pair_id", "story", "part", "paragraph", "text"), ["pair_id", "story", "part", "paragraph"], "left")
    rows = own.join(given, ["pair_id", "story", "part"]).where(fits(F.col("_tag"), F.col("tag")) & fits(F.col("_paragraph"), F.col("paragraph")))
    told, slot = F.struct("start", "stop", "placeholder", "style"), F.col("_slot")
    rows = rows.select("pair_id", "slot_id", "occurrence", "control_no", "story", "part", "paragraph", "alias", boundary(slot, told, F.col("text")).alias("boundary"), marker_differs(slot["style"], told).alias("marker"))
    place = F.row_number().over(W.partitionBy("pair_id", "slot_id").orderBy("control_no"))
    rows = rows.withColumn("_n", place).where("occurrence is null or occurrence = _n")
    control = F.struct("story", "part", "paragraph", "alias", "boundary", "marker")
    return rows.groupBy("pair_id", "slot_id").agg(F.count("*").alias("n"), F.min_by(control, "control_no").alias("control"))


def match_slots(gold: DataFrame, actual: DataFrame, gold_controls: DataFrame, actual_controls: DataFrame) -> DataFrame:
    """(pair_id, slot_id, gold, actual, gold_control, actual_control, status): MATCHED, MISSING or AMBIGUOUS; the controls are those of controls_of.

    An actual slot has the gold slot's id, else its tag, story and part, if just one has; then each side's locator must
    name one control. Slots meet all that has their id where they lie; only those without it go on to ask by tag.
    """
    mine = gold_controls.select("pair_id", "slot_id", F.col("n").alias("n_gold"), F.col("control").alias("gold_control"))
    theirs = actual_controls.select("pair_id", "slot_id", F.col("n").alias("n_actual"), F.col("control").alias("actual_control"))
    some = F.first(F.struct(*ACTUAL_SLOT))
    by_id = actual.groupBy("pair_id", "slot_id").agg(F.count("*").alias("found"), some.alias("actual"))
    tags = actual.groupBy(F.col("pair_id").alias("_pair"), F.col("tag").alias("_tag"), F.col("story").alias("_story"), F.col("part").alias("_part")).agg(F.count("*").alias("found"), some.alias("actual"))
    rows = gold.select("pair_id", "slot_id", "tag", "story", "part", F.struct(*GOLD_SLOT).alias("gold")).join(mine, ["pair_id", "slot_id"], "left").join(by_id, ["pair_id", "slot_id"], "left")
    named = rows.where("found is not null").join(theirs, ["pair_id", "slot_id"], "left")
    other = rows.where("found is null").drop("found", "actual").join(tags, (F.col("pair_id") == F.col("_pair")) & F.col("tag").eqNullSafe(F.col("_tag")) & (F.col("story") == F.col("_story")) & (F.col("part") == F.col("_part")), "left")
    other = other.withColumn("_slot", F.when(F.col("found") == 1, F.col("actual.slot_id"))).join(theirs.withColumnRenamed("slot_id", "_slot"), ["pair_id", "_slot"], "left")
    every = ["pair_id", "slot_id", "gold", "found", "actual", "n_gold", "gold_control", "n_actual", "actual_control"]
    rows = named.select(*every).unionByName(other.select(*every))
    n_gold, n_actual, found = (F.coalesce(c, F.lit(0)) for c in ("n_gold", "n_actual", "found"))
    status = F.when(found > 1, "AMBIGUOUS").when(found == 0, "MISSING").when((n_gold == 1) & (n_actual == 1), "MATCHED").when((n_gold == 0) | (n_actual == 0), "MISSING").otherwise("AMBIGUOUS")
    return rows.select("pair_id", "slot_id", "gold", F.when(found == 1, F.col("actual")).alias("actual"), "gold_control", "actual_control", status.alias("status"))


def evaluate_slots(gold: DataFrame, actual: DataFrame, gold_controls: DataFrame, actual_controls: DataFrame, gold_texts: DataFrame, actual_texts: DataFrame, registry: DataFrame) -> DataFrame:
    """(pair_id, slot_id, check, dimension, status, required, code): slots of a contract against the gold one's.

    Slots: (pair_id, slot_id, required, tag, story, part, paragraph, occurrence, start, stop, left_anchor, right_anchor,
    field_id, content_type, style map); controls: (pair_id, control_no, tag, alias, story, part, paragraph, start, stop,
    placeholder, style map); texts: (pair_id, story, part, paragraph, text); registry: (field_id, content_type).
    """
    rows = match_slots(gold, actual, controls_of(gold, gold_controls, gold_texts), controls_of(actual, actual_controls, actual_texts))
    rows = rows.join(registry.select(F.col("field_id").alias("_field"), F.col("content_type").alias("_type")), F.col("actual.field_id") == F.col("_field"), "left")
    g, a, gc, ac = (F.col(c) for c in ("gold", "actual", "gold_control", "actual_control"))
    required = g["required"]
    of = lambda c: F.struct(c["story"], c["part"], c["paragraph"])
    row = lambda check, dimension, good, code: F.struct(F.lit(check).alias("check"), F.lit(dimension).alias("dimension"), F.when(good, "PASS").otherwise("FAIL").alias("status"), F.when(~good, code).alias("code"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    mapped = sure((a["field_id"] == g["field_id"]) & (ac["alias"] == a["field_id"]) & (gc["alias"] == g["field_id"]) & (F.col("_type") == a["content_type"]))
    styled = ~(styles_differ(g["style"], a["style"]) | ac["marker"] | gc["marker"])
    matched = F.array(
        row("inventory", "slot.inventory", F.lit(True), F.lit(None).cast("string")),
        row("location", "slot.location_boundary", of(gc).eqNullSafe(of(ac)), F.lit(MOVED)),
        row("boundary", "slot.location_boundary", gc["boundary"].eqNullSafe(ac["boundary"]), F.lit("slot_overlaps_protected")),
        row("field_id", "slot.field_mapping", mapped, F.lit("slot_field_mapping_invalid")),
        row("value_style", "slot.value_style", sure(styled), F.lit(None).cast("string")),
    )
    gone = F.when((F.col("status") == "MISSING") & a.isNull(), F.when(required, "required_slot_missing").otherwise("optional_slot_missing")).otherwise(MISMATCH)
    before = F.when(required, "required_slot_prerequisite_missing").otherwise("optional_slot_prerequisite_missing")
    failed = F.array(row("inventory", "slot.inventory", F.lit(False), gone), *[row("prerequisite", d, F.lit(False), before) for d in PREREQUISITES])
    told = rows.select("pair_id", "slot_id", required.alias("required"), F.when(F.col("status") == "MATCHED", matched).otherwise(failed).alias("_rows"))
    # never empty; over a column, a plain inline would test that first, working out each row again
    own = told.select("pair_id", "slot_id", "required", F.inline_outer("_rows"))
    extra = actual.select("pair_id", "slot_id").distinct().join(gold.select("pair_id", "slot_id"), ["pair_id", "slot_id"], "left_anti").withColumn("check", F.lit("inventory.extra")).withColumn("code", F.lit("extra_slot"))
    loose = actual_controls.where("tag is not null").join(actual.select("pair_id", "tag"), ["pair_id", "tag"], "left_anti").select("pair_id", F.col("tag").alias("slot_id"), F.lit("inventory.broken").alias("check"), F.lit(MISMATCH).alias("code"))
    more = extra.unionByName(loose).select("pair_id", "slot_id", "check", F.lit("slot.inventory").alias("dimension"), F.lit("FAIL").alias("status"), F.lit(True).alias("required"), "code")
    return own.select(*more.columns).unionByName(more)


def locate_regions(regions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(pair_id, region_id, located, at): PASS and the paragraph that a region's locator names alone, by coordinates, anchors and occurrence.

    Where none fits, its coordinates count alone, if there are any. Several are UNKNOWN; none is FAIL for a required
    region, else NOT_APPLICABLE.
    """
    wanted = regions.select("pair_id", "region_id", "story", "part", *[F.col(c).alias(f"_{c}") for c in COORDINATES], "left_anchor", "right_anchor", "occurrence")
    rows = wanted.join(paragraphs, ["pair_id", "story", "part"])
    for c in COORDINATES:
        rows = rows.where(fits(F.col(f"_{c}"), F.col(c)))
    anchored = (F.col("left_anchor").isNull() | F.col("text").contains(F.col("left_anchor"))) & (F.col("right_anchor").isNull() | F.col("text").contains(F.col("right_anchor")))
    place = F.sum(anchored.cast("int")).over(W.partitionBy("pair_id", "region_id").orderBy("paragraph"))
    exact = anchored & (F.col("occurrence").isNull() | (F.col("occurrence") == place))
    at = F.struct("paragraph", "section", "table_index", "row", "cell", "text", "runs")
    counts = rows.withColumn("_exact", exact).groupBy("pair_id", "region_id").agg(F.count_if("_exact").alias("n"), F.min_by(F.when(F.col("_exact"), at), F.when(F.col("_exact"), F.col("paragraph"))).alias("one"), F.count("*").alias("m"), F.min_by(at, "paragraph").alias("only"))
    addressed = F.lit(False)
    for c in COORDINATES:
        addressed = addressed | F.col(c).isNotNull()
    n, m = F.coalesce("n", F.lit(0)), F.when(addressed, F.coalesce("m", F.lit(0))).otherwise(0)
    status = F.when((n == 1) & (F.col("expected") == 1), "PASS").when(n > 0, "UNKNOWN").when(m == 0, F.when(F.col("required"), "FAIL").otherwise("NOT_APPLICABLE")).when((m != F.col("expected")) | (m != 1), "UNKNOWN").otherwise("PASS")
    both = regions.join(counts, ["pair_id", "region_id"], "left").withColumn("located", status)
    return both.select("pair_id", "region_id", "located", F.when(F.col("located") == "PASS", F.when(n == 1, F.col("one")).otherwise(F.col("only"))).alias("at"))


def region_style(text: Column, at: Column) -> Column:
    """The style of the run that holds the declared text's beginning, else of the first run."""
    start = F.position(text, at["text"]) - 1
    holding = F.filter(at["runs"], lambda r: (r["start"] <= start) & (start < F.greatest(r["stop"], r["start"] + 1)))
    return F.coalesce(F.when((text != "") & (start >= 0), F.get(holding, F.lit(0))["style"]), F.get(at["runs"], F.lit(0))["style"])


def objects_by_kind(objects: DataFrame, name: str) -> DataFrame:
    """(pair_id, object_kind, name): the first object of each kind; supported ones come first."""
    value = F.struct("kind", "content_sha256", "target", "status", "xml")
    return objects.groupBy("pair_id", F.col("kind").alias("object_kind")).agg(F.min_by(value, F.struct("unsupported", "object_no")).alias(name))


def evaluate_regions(regions: DataFrame, gold: DataFrame, actual: DataFrame, gold_objects: DataFrame, actual_objects: DataFrame) -> DataFrame:
    """(pair_id, region_id, dimension, status, required, code): protected regions of the gold contract, located on both sides.

    Regions: (pair_id, region_id, required, story, part, section, paragraph, table_index, row, cell, left_anchor,
    right_anchor, occurrence, expected, text, object_kind, object_sha256); paragraphs: coordinates, text, and runs
    (start, stop, style map); objects: (pair_id, object_no, kind, unsupported, content_sha256, target, status, xml).
    A region of an object has no text, structure or style; one of text no object.
    """
    keys = ["pair_id", "region_id"]
    texts, things = regions.where("object_kind is null"), regions.where("object_kind is not null")
    rows = texts.join(locate_regions(texts, gold).withColumnsRenamed({"located": "g", "at": "g_at"}), keys).join(locate_regions(texts, actual).withColumnsRenamed({"located": "a", "at": "a_at"}), keys)
    base, text, mine, theirs = F.when(F.col("g") != "PASS", F.col("g")).otherwise(F.col("a")), F.col("text"), F.col("g_at"), F.col("a_at")
    row = lambda dimension, status, required, code: F.struct(F.lit(f"protected.{dimension}").alias("dimension"), status.alias("status"), required.alias("required"), F.when(status == "FAIL", code).alias("code"))
    none, needed, off = F.lit("NOT_APPLICABLE"), F.col("required"), F.lit(False)
    content = F.when(text.isNull(), none).when(theirs["text"].contains(text), "PASS").otherwise("FAIL")
    same = F.lit(True)
    for c in COORDINATES:
        same = same & (F.col(c).isNull() | mine[c].eqNullSafe(theirs[c]))
    styled = F.when(styles_differ(region_style(text, mine), region_style(text, theirs)), "FAIL").otherwise("PASS")
    rows = rows.select(*keys, "required", base.alias("_base"), content.alias("_content"), F.when(same, "PASS").otherwise("FAIL").alias("_structure"), styled.alias("_style"))
    base = F.col("_base")
    lost = F.array(*[row(d, none if d == "object" else base, needed, F.lit(MISSING_TEXT)) for d in ("content", "structure", "style", "object")])
    kept = F.array(row("content", F.col("_content"), needed, F.lit(MISSING_TEXT)), row("structure", F.col("_structure"), needed, F.lit(MOVED)), row("style", F.col("_style"), needed, F.lit(None).cast("string")), row("object", none, off, F.lit(None).cast("string")))
    told = rows.select(*keys, F.inline(F.when(base == "PASS", kept).otherwise(lost)))
    pairs = things.join(objects_by_kind(gold_objects, "mine"), ["pair_id", "object_kind"], "left").join(objects_by_kind(actual_objects, "theirs"), ["pair_id", "object_kind"], "left")
    equal = F.coalesce((F.col("mine") == F.col("theirs")) & (F.col("object_sha256").isNull() | (F.col("theirs.content_sha256") == F.col("object_sha256"))), F.lit(False))
    verdict = F.when(F.col("object_kind") == "unsupported", "UNKNOWN").when(equal & F.col("mine").isNotNull(), "PASS").otherwise("FAIL")
    seen = F.array(*[row(d, none, off, F.lit(None).cast("string")) for d in ("content", "structure", "style")], row("object", verdict, needed, F.lit(BROKEN_OBJECT)))
    return told.unionByName(pairs.select(*keys, F.inline(seen)))
