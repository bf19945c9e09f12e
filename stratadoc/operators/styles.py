"""Style inheritance and dependency graphs, as recursive queries and folds."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graphs import find_cycles, reachable  # noqa: F401  part of this module's operators
from .lineage import cut

def style_chain(styles: DataFrame) -> DataFrame:
    """(style_id, ancestor, depth, reason): each style's chain upward, depth 0 itself.

    reason is set on the last row: cycle (an ancestor comes again; the whole chain is void), missing (an ancestor isn't
    there) or wrong_type. Chains double their length each round, so a chain of any depth takes a logarithmic number of
    rounds; a chain that meets itself stops growing.
    """
    own = styles.select(F.col("style_id").alias("parent"), F.col("style_type").alias("parent_type"), F.lit(True).alias("there"))
    links = cut(styles.where("based_on is not null").select("style_id", F.col("based_on").alias("parent"), "style_type").join(own, "parent", "left"))
    ends = F.when(F.col("there").isNull(), "missing").when(F.col("parent_type") != F.col("style_type"), "wrong_type")
    links = links.select("style_id", "parent", ends.alias("reason"))
    first = links.where("reason is null").select("style_id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    above, length, open_ = first, 1, first
    while open_.take(1):
        further = open_.join(above.select(F.col("style_id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more")), "ancestor").select("style_id", F.col("next").alias("ancestor"), (F.lit(length) + F.col("more")).alias("depth"))
        above, length = cut(above.unionByName(further)), 2 * length
        again = above.groupBy("style_id", "ancestor").agg(F.count("*").alias("n")).where("n > 1 or ancestor = style_id").select("style_id").distinct()
        open_ = above.where(F.col("depth") == length).join(again, "style_id", "left_anti")
    every = styles.select("style_id", F.col("style_id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(above)
    place = F.row_number().over(W.partitionBy("style_id", "ancestor").orderBy("depth"))
    met = every.withColumn("_n", place).where("_n = 2").groupBy("style_id").agg(F.min("depth").alias("at"))
    rows = every.join(met, "style_id", "left").where("at is null or depth <= at").select("style_id", "ancestor", "depth", F.when(F.col("depth") == F.col("at"), "cycle").alias("reason"))
    last = rows.where("reason is null").join(links.where("reason is not null").select(F.col("style_id").alias("ancestor"), "parent", F.col("reason").alias("end")), "ancestor")
    return rows.unionByName(last.select("style_id", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.col("end").alias("reason")))


#: Names of heading styles with their levels; fixed pattern.
HEADING_STYLE = r"^(?i:heading|标题)\s*([1-3])$"


def outline_levels(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """Paragraphs with level (0 to 2) and source, those of the outline alone: the paragraph's own level, else that of the nearest style of its chain that has one, else its style's name.

    paragraphs(.., outline, style_id), styles(style_id, based_on, style_type, outline, name). An own level that is no
    number or above 2 keeps a paragraph out; a style's that is no number leaves it to the name; one above 2 keeps it out.
    """
    chain = style_chain(styles.select("style_id", "based_on", "style_type"))
    void = chain.where("reason = 'cycle'").select("style_id").distinct()
    chain = chain.where("reason is null").join(void, "style_id", "left_anti")
    own = styles.select(F.col("style_id").alias("ancestor"), F.col("outline").alias("_outline"), "name")
    of_style = chain.join(own, "ancestor").groupBy("style_id").agg(F.min_by("_outline", F.when(F.col("_outline").isNotNull(), F.col("depth"))).try_cast("int").alias("_inherited"), F.max(F.when(F.col("depth") == 0, F.regexp_extract("name", HEADING_STYLE, 1))).alias("_heading"))
    rows = paragraphs.join(of_style, "style_id", "left")
    direct, named = F.col("outline").try_cast("int"), F.col("_heading").try_cast("int") - 1
    level = F.when(F.col("outline").isNotNull(), direct).otherwise(F.coalesce("_inherited", named))
    source = F.when(F.col("outline").isNotNull(), "paragraph_outline_level").when(F.col("_inherited").isNotNull(), "paragraph_style_outline_level").otherwise("built_in_heading_style")
    return rows.withColumn("level", level).withColumn("source", source).where("level between 0 and 2").select(*paragraphs.columns, "level", "source")


def resolve_chain(chain: DataFrame, props: DataFrame) -> DataFrame:
    """(style_id, path, value, source): for each property the value of the nearest ancestor that sets it; void chains give none."""
    void = chain.where("reason = 'cycle'").select("style_id").distinct()
    rows = chain.where("reason is null").join(void, "style_id", "left_anti").join(props.withColumnRenamed("style_id", "ancestor"), "ancestor")
    return rows.groupBy("style_id", "path").agg(F.min_by("value", "depth").alias("value"), F.min_by("ancestor", "depth").alias("source"))


#: Order in which layers are written, the weakest first; the path whose values are tab stops; what stands in for each other; implicit values; fixed values.
LAYERS = ("doc_defaults", "paragraph_style", "paragraph_direct", "paragraph_mark_direct", "character_style", "run_direct")
TABS = "paragraph.tab_stops"
FALLBACKS = (("run.font_ascii", "run.font_hansi"), ("run.font_hansi", "run.font_ascii"))
IMPLICIT = {
    "run.bold": "false", "run.italic": "false", "run.color": "auto", "run.underline": None, "run.strikethrough": "false", "run.vertical_position": "baseline", "run.character_spacing_pt": "0.0",
    "paragraph.space_before_pt": "0.0", "paragraph.space_after_pt": "0.0", "paragraph.page_break_before": "false", "paragraph.numbering": None, "paragraph.tab_stops": None,
}
STEP = "struct<layer:string,source:string,path:string,value:string,toggle:boolean,tabs:array<struct<key:int,value:string>>>"
TRAIL = "array<struct<layer:string,source:string,action:string,value:string>>"


def tab_text(tabs: Column) -> Column:
    """Tab stops by position as JSON, null for none."""
    stops = F.transform(F.array_sort(F.map_entries(tabs)), lambda e: F.struct(e["key"].alias("position"), e["value"].alias("alignment")))
    return F.when(F.size(tabs) > 0, F.to_json(stops))


def written_by(steps: Column, path: Column) -> Column:
    """(value, trail) of a path after the steps in order: the last writer wins, toggles of styles flip, tab stops merge by position and `clear` takes one away."""
    own = F.filter(steps, lambda x: x["path"] == path)
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("map<int,string>").alias("tabs"), F.array().cast(TRAIL).alias("trail"))

    def step(at: Column, x: Column) -> Column:
        style = x["layer"].endswith("_style") & F.coalesce(x["toggle"], F.lit(False))
        before = F.coalesce(at["value"], F.lit("false"))
        flipped = F.when(before == "true", "false").otherwise("true")
        none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
        tabs = F.map_filter(F.map_zip_with(F.coalesce(at["tabs"], none), F.coalesce(F.map_from_entries(x["tabs"]), none), lambda _, old, new: F.coalesce(new, old)), lambda _, v: v != "clear")
        value = F.when(path == TABS, tab_text(tabs)).when(style & (x["value"] == "true"), flipped).when(style, before).otherwise(x["value"])
        action = F.when(path == TABS, "merge").when(style & (x["value"] == "true"), "toggle").when(style, "toggle_noop").otherwise("set")
        made = F.struct(x["layer"].alias("layer"), x["source"].alias("source"), action.alias("action"), value.alias("value"))
        return F.struct(value.alias("value"), F.when(path == TABS, tabs).alias("tabs"), F.concat(at["trail"], F.array(made)).cast(TRAIL).alias("trail"))

    return F.aggregate(own, start, step, lambda at: F.struct(at["value"].alias("value"), at["trail"].alias("trail")))


def effective_styles(occurrences: DataFrame, styles: DataFrame, properties: DataFrame) -> DataFrame:
    """(occurrence_id, path, value, trail) of each property in effect at each occurrence, with all that wrote it in order.

    occurrences(occurrence_id, paragraph_style, character_style), styles(style_id, based_on, style_type), properties(layer,
    owner, part, path, value, toggle, tabs): those of a style have layer style and its id as owner, others a layer of
    LAYERS and an occurrence's id (none for doc_defaults); part is run or paragraph, tabs map positions to alignments.
    Document defaults come first, run before paragraph, then the paragraph's style from its farthest base, each with its
    paragraph's properties before its run's, then what the paragraph says itself, its mark, the character's style and the
    run. A chain of styles ends before a base that is missing or of another type; one that meets itself gives nothing.
    Then each of the two font names stands in for the other, and implicit values fill what nobody wrote.
    What the styles of an occurrence give is worked out once for each pair of them, defaults and fallbacks included; an
    occurrence works out again only the paths that it writes itself.
    """
    step = F.struct("layer", F.col("owner").cast("string").alias("source"), "path", "value", "toggle", F.map_entries("tabs").alias("tabs")).cast(STEP)
    listed = lambda *order: F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col("path").alias("_p"), step.alias("step")))), lambda x: x["step"])
    chain = style_chain(styles)
    void = chain.where("reason = 'cycle'").select("style_id").distinct()
    chain = chain.where("reason is null").join(void, "style_id", "left_anti").join(styles.select("style_id", "style_type"), "style_id")
    of_style = properties.where("layer = 'style'").drop("layer").withColumnRenamed("owner", "ancestor")
    steps = chain.join(of_style, "ancestor").where("style_type <> 'character' or part = 'run'").withColumn("layer", F.concat("style_type", F.lit("_style"))).withColumn("owner", F.col("ancestor"))
    steps = cut(steps.groupBy("style_id", "style_type").agg(listed((-F.col("depth")).alias("_d"), F.col("part").alias("_s")).alias("steps")))
    direct = properties.where("layer <> 'style' and layer <> 'doc_defaults'").groupBy(F.col("owner").alias("occurrence_id"))
    direct = direct.agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("layer") == x, F.struct(F.col("path").alias("_p"), step.alias("step"))))), lambda v: v["step"]).alias(f"_{x}") for x in LAYERS if x.endswith("_direct")])
    defaults = properties.where("layer = 'doc_defaults'").agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("part") == "paragraph").alias("_s"), F.col("path").alias("_p"), step.alias("step")))), lambda x: x["step"]).alias("steps")).first()[0]
    known = F.from_json(F.lit(json.dumps([x.asDict(True) for x in defaults or []])), f"array<{STEP}>")
    none = F.array().cast(f"array<{STEP}>")
    entry = lambda path, of: F.struct(path.alias("path"), of["value"].alias("value"), of["trail"].alias("trail"))
    has = lambda own, path: F.exists(own, lambda x: x["path"] == path)
    of = lambda own, path: F.get(F.filter(own, lambda x: x["path"] == path), F.lit(0))
    one = lambda path, source, layer, action, value: F.array(F.struct(F.lit(layer).alias("layer"), F.lit(source).alias("source"), F.lit(action).alias("action"), value.alias("value"))).cast(TRAIL)

    def derived(own: str) -> list[Column]:
        made = lambda path, other, found: F.struct(F.lit(path).alias("path"), found["value"].alias("value"), F.concat(found["trail"], one(path, other, "word_font_fallback", "derive", found["value"])).alias("trail"))
        return [F.when(~has(own, path) & has(own, other), made(path, other, of(own, other))) for path, other in FALLBACKS]

    pairs = occurrences.select("paragraph_style", "character_style").distinct()
    for kind in ("paragraph", "character"):
        # styles that aren't there have no steps; they are dealt by the other one, so that they don't all meet in one task
        other = F.when(F.col(f"{kind}_style").isNull(), F.hash("character_style" if kind == "paragraph" else "paragraph_style") % 4096)
        mine = steps.where(F.col("style_type") == kind).select(F.col("style_id").alias(f"{kind}_style"), F.lit(0).alias("_deal"), F.col("steps").alias(f"_{kind}_style"))
        pairs = pairs.withColumn("_deal", F.coalesce(other, F.lit(0))).join(mine, [f"{kind}_style", "_deal"], "left").drop("_deal")
    given = F.concat(known, F.coalesce("_paragraph_style", none), F.coalesce("_character_style", none))
    own = F.transform(F.array_distinct(F.transform(given, lambda x: x["path"])), lambda p: entry(p, written_by(given, p)))
    pairs = pairs.withColumn("_own", own)
    added = derived("_own")
    for path, value in IMPLICIT.items():
        v = F.lit(value).cast("string")
        added.append(F.when(~has("_own", path), F.struct(F.lit(path).alias("path"), v.alias("value"), one(path, "ECMA-376", "word_implicit_default", "default", v).alias("trail"))))
    pairs = pairs.select(F.struct("paragraph_style", "character_style").alias("_pair"), "_paragraph_style", "_character_style", F.concat("_own", F.array_compact(F.array(*added))).alias("_given"))
    rows = occurrences.select("occurrence_id", F.struct("paragraph_style", "character_style").alias("_pair")).join(direct, "occurrence_id", "left").join(pairs, "_pair")
    every = F.concat(known, *[F.coalesce(F.col(f"_{x}"), none) for x in LAYERS[1:]])
    touched = F.array_distinct(F.transform(F.concat(*[f"_{x}" for x in LAYERS if x.endswith("_direct")]), lambda x: x["path"]))
    fonts = F.array(*[F.lit(path) for path, _ in FALLBACKS])
    rows = rows.withColumn("_touched", F.when(F.arrays_overlap(touched, fonts), F.array_union(touched, fonts)).otherwise(touched))
    again = F.filter(F.transform("_touched", lambda p: entry(p, written_by(every, p))), lambda x: (F.size(x["trail"]) > 0) | x["path"].isNull())
    rows = rows.withColumn("_again", F.when(F.col("_touched").isNotNull(), again))
    left = F.filter("_given", lambda x: ~F.exists("_touched", lambda p: p.eqNullSafe(x["path"])))
    rows = rows.select("occurrence_id", F.when(F.col("_touched").isNull(), F.col("_given")).otherwise(F.concat(left, "_again", F.array_compact(F.array(*derived("_again"))))).alias("_all"))
    # never empty; over a column, a plain inline would test that first, working out each row again
    return rows.select("occurrence_id", F.inline_outer("_all"))


#: A value that stands for a parameter as a whole; fixed pattern.
PARAMETER = r"^\$\{([a-z][a-z0-9_]*)\}$"


def prefixes(path: Column) -> Column:
    """The paths that a dotted path lies below."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def merged(layers: DataFrame, key: str) -> DataFrame:
    """(key, path, value, source) of layers(key, path, value, source, rank): nested values merged by dotted paths, lower ranks over higher ones.

    A value replaces one at its path, all below it, and one at a path that it lies below, of every higher rank.
    """
    best = layers.groupBy(key, "path").agg(F.min_by(F.struct("value", "source"), "rank").alias("_v"), F.min("rank").alias("rank"))
    above = best.where(F.contains("path", F.lit("."))).select(key, "path", F.col("rank").alias("_own"), F.explode(prefixes(F.col("path"))).alias("_prefix"))
    below = above.groupBy(key, F.col("_prefix").alias("path")).agg(F.min("_own").alias("_below"))
    hidden = above.join(best.select(key, F.col("path").alias("_prefix"), "rank"), [key, "_prefix"]).where("rank < _own").select(key, "path").distinct()
    kept = best.join(hidden, [key, "path"], "left_anti").join(below, [key, "path"], "left").where("_below is null or _below >= rank")
    return kept.select(key, "path", F.col("_v.value").alias("value"), F.col("_v.source").alias("source"))


def resolve_roles(roles: DataFrame, values: DataFrame, profiles: DataFrame, required: DataFrame, parameters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(role_id, path, state, value, source) of each path that a role's type requires, and (role_id, code, detail) of what is wrong.

    roles(role_id, role_type, based_on), values(role_id, overrides, path, value) with dotted paths, profiles(role_type,
    path, value), required(role_type, path), parameters(name, value). From the weakest: the type's profile, the roles it
    is based on from the farthest, its own values, its overrides. A value that is a parameter as a whole becomes that
    parameter's. States are VALUE, NONE (none) and N/A; a required path with others below it has them as JSON. Codes:
    role_cycle, role_missing, type_mismatch (a base of another type), type_unknown (nothing required), profile_missing,
    parameter_missing, path_missing and value_blank. A role with one of the first five has no properties.
    """
    chain = cut(style_chain(roles.select(F.col("role_id").alias("style_id"), "based_on", F.col("role_type").alias("style_type"))))
    code = F.create_map(*[F.lit(x) for x in ("cycle", "role_cycle", "missing", "role_missing", "wrong_type", "type_mismatch")])[F.col("reason")]
    wrong = chain.where("reason is not null").select(F.col("style_id").alias("role_id"), code.alias("code"), F.col("ancestor").cast("string").alias("detail"))
    kinds = roles.select("role_id", "role_type")
    wrong = wrong.unionByName(kinds.join(required, "role_type", "left_anti").select("role_id", F.lit("type_unknown").alias("code"), F.col("role_type").alias("detail")))
    wrong = wrong.unionByName(kinds.join(required, "role_type", "left_semi").join(profiles, "role_type", "left_anti").select("role_id", F.lit("profile_missing").alias("code"), F.col("role_type").alias("detail")))
    good = kinds.join(wrong.select("role_id").distinct(), "role_id", "left_anti")
    of_chain = chain.where("reason is null").select(F.col("style_id").alias("role_id"), F.col("ancestor").alias("_of"), "depth").join(good, "role_id", "left_semi")
    own = of_chain.join(values.withColumnRenamed("role_id", "_of"), "_of").select("role_id", "path", "value", F.col("_of").cast("string").alias("source"), (2 * F.col("depth") + F.when(F.col("overrides"), 0).otherwise(1)).alias("rank"))
    weakest = good.join(profiles, "role_type").select("role_id", "path", "value", F.concat(F.lit("profile:"), "role_type").alias("source"), F.lit(2**31 - 1).alias("rank"))
    name = F.regexp_extract("value", PARAMETER, 1)
    known = parameters.select(F.col("name").alias("_name"), F.col("value").alias("_value"), F.lit(True).alias("_known"))
    whole = cut(merged(own.unionByName(weakest), "role_id").withColumn("_name", F.when(name != "", name)).join(known, "_name", "left"))
    wrong = wrong.unionByName(whole.where("_name is not null and _known is null").select("role_id", F.lit("parameter_missing").alias("code"), F.col("_name").alias("detail")).distinct())
    leaves = whole.select("role_id", "path", F.when(F.col("_name").isNull(), F.col("value")).otherwise(F.col("_value")).alias("value"), "source")
    nested = leaves.where(F.contains("path", F.lit("."))).select("role_id", F.explode(prefixes(F.col("path"))).alias("_at"), "path", "value")
    nested = nested.groupBy("role_id", F.col("_at").alias("path")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.expr("substring(path, length(_at) + 2)"), "value"))))).alias("_below"))
    asked = good.join(required, "role_type").select("role_id", "path")
    rows = asked.join(leaves.withColumn("_there", F.lit(True)), ["role_id", "path"], "left").join(nested, ["role_id", "path"], "left").withColumn("value", F.coalesce("value", "_below"))
    absent, blank = F.col("_there").isNull() & F.col("_below").isNull(), F.coalesce(F.col("value"), F.lit("")) == ""
    wrong = wrong.unionByName(rows.where(absent).select("role_id", F.lit("path_missing").alias("code"), F.col("path").alias("detail"))).unionByName(rows.where(~absent & blank).select("role_id", F.lit("value_blank").alias("code"), F.col("path").alias("detail")))
    state = F.when(F.col("value") == "N/A", "N/A").when(F.col("value") == "none", "NONE").otherwise("VALUE")
    return rows.where(~absent & ~blank).select("role_id", "path", state.alias("state"), F.when(state == "VALUE", F.col("value")).alias("value"), "source"), wrong


def cascade(layers: DataFrame) -> DataFrame:
    """(occurrence_id, path, value, trail): layers in rank order; the last writer wins, but toggles of style layers flip.

    trail keeps who wrote what. A direct layer overwrites a toggle.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", "value", "toggle", "direct")))
    start = F.lit(None).cast("string")
    flip: Column = F.aggregate(listed, start, lambda a, x: F.when(x["toggle"] & ~x["direct"] & (x["value"] == "true"), F.when(F.coalesce(a, F.lit("false")) == "true", "false").otherwise("true")).when(x["toggle"] & ~x["direct"], F.coalesce(a, x["value"])).otherwise(x["value"]))
    return layers.groupBy("occurrence_id", "path").agg(flip.alias("value"), F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["rank"].cast("string"), x["value"])), ",").alias("trail"))


def select_roles(actual: DataFrame, school: DataFrame, preset: DataFrame) -> DataFrame:
    """Per role the complete school style, else the complete preset; never a mixture of both."""
    whole = lambda df, n: df.select("role", F.struct("digest", "properties").alias(n))
    rows = actual.join(whole(school.where("complete"), "s"), "role", "left").join(whole(preset.where("complete"), "p"), "role", "left")
    chosen = F.coalesce("s", "p")
    return rows.select("role", F.when(F.col("s").isNotNull(), "school").when(F.col("p").isNotNull(), "preset").otherwise("none").alias("origin"), chosen["digest"].alias("digest"), F.size(chosen["properties"]).alias("properties"))


def check_closure(props: DataFrame, profile: DataFrame) -> DataFrame:
    """(role, path, code): a role's properties against its profile's: missing, extra, or a state that isn't allowed."""
    rows = props.select("role", "path", "state").join(profile.select("role", "path", "allow_none", F.lit(True).alias("_p")), ["role", "path"], "full")
    code = F.when(F.col("state").isNull(), "missing").when(F.col("_p").isNull(), "extra").when((F.col("state") == "NONE") & ~F.col("allow_none"), "state_not_allowed")
    return rows.select("role", "path", code.alias("code")).where("code is not null")


def build_occurrences(fills: DataFrame, projections: DataFrame, refs: DataFrame) -> DataFrame:
    """Direct fills, except those of the reference list, and projections numbered by role, with their style references."""
    n = F.row_number().over(W.partitionBy("doc_id", "role").orderBy("block"))
    projected = projections.select("doc_id", "role", F.concat(F.lit("projection:"), "role", F.lit(":"), n.cast("string")).alias("occurrence_id"))
    direct = fills.where("role <> 'references'").select("doc_id", "role", F.concat(F.lit("fill:"), F.col("block").cast("string")).alias("occurrence_id"))
    return direct.unionByName(projected).join(refs, "role", "left")


def fill_missing_roles(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected roles that nobody observed, as MISSING observations beside the others."""
    gone = expected.join(observed.select("doc_id", "role"), ["doc_id", "role"], "left_anti").withColumn("state", F.lit("MISSING"))
    return observed.select("doc_id", "role", "state").unionByName(gone.select("doc_id", "role", "state"))


def actual_roles(parts: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, role, sources): the union of roles from several places, and which places named each."""
    rows = None
    for name, df in parts.items():
        own = df.select("doc_id", "role").withColumn("source", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("doc_id", "role").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def canonical_props(df: DataFrame) -> DataFrame:
    """Canonical values of raw style properties: one font of an equal pair, #colours, line spacing by mode, outline levels from 1."""
    spacing = F.when((F.col("line_rule") == "auto") & (F.col("line") == 240), "single").when(F.col("line_rule") == "auto", "multiple").when(F.col("line_rule") == "exact", "exact_pt").when(F.col("line_rule") == "atLeast", "at_least_pt")
    value = F.when(F.col("line_rule") == "auto", F.col("line") / 240).otherwise(F.col("line") / 20)
    return df.select(
        "owner",
        F.when(F.col("font_a") == F.col("font_b"), F.col("font_a")).alias("font"),
        F.when(F.col("font_a") != F.col("font_b"), "conflict").otherwise(F.when(F.col("font_a").isNull(), "missing").otherwise("value")).alias("font_state"),
        F.when(F.col("colour").rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper("colour"))).alias("colour"),
        spacing.alias("spacing"),
        value.alias("spacing_value"),
        F.when((F.col("outline") >= 0) & (F.col("outline") < 9), F.col("outline") + 1).alias("outline_level"),
    )
