"""Scores and verdicts of evaluated pairs from their assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points of each dimension, and failures that decide alone; fixed values.
WEIGHTS = {
    "protected.content": 20.0, "protected.structure": 10.0, "protected.style": 15.0, "protected.object": 5.0,
    "slot.inventory": 15.0, "slot.location_boundary": 15.0, "slot.field_mapping": 10.0, "slot.value_style": 10.0,
}
HARD_FAILURES = (
    "actual_template_invalid", "actual_contract_invalid", "template_contract_marker_mismatch", "required_protected_content_missing_or_changed",
    "required_protected_object_missing_or_broken", "required_slot_missing", "extra_slot", "slot_overlaps_protected", "slot_field_mapping_invalid",
    "forbidden_residue_present", "wrong_structural_location",
)
STATUSES = {"passed": "PASS", "failed": "FAIL", "unknown": "UNKNOWN", "not_applicable": "NOT_APPLICABLE"}


def status_counts(assertions: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(pair_id, dimension, weight, counts) of each weighted dimension, also those that a pair has none of: one row a pair until its counts are complete. Null is no pair, so it has no counts."""
    named = {(d, k): f"_{i}_{k}" for i, d in enumerate(weights) for k in STATUSES}
    counts = assertions.groupBy("pair_id").agg(*[F.count_if(F.col("pair_id").isNotNull() & (F.col("dimension") == d) & (F.col("status") == STATUSES[k])).alias(c) for (d, k), c in named.items()])
    rows = [F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("weight"), *[F.col(named[d, k]).alias(k) for k in STATUSES]) for d, w in weights.items()]
    return counts.select("pair_id", F.inline(F.array(*rows)))


def dimension_scores(assertions: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weight times the share passed; unknown ones count as not passed, twice so in the inventory's F1.

    Without comparable assertions a dimension is full if something in it was not applicable, else empty.
    """
    rows = status_counts(assertions, weights)
    p, f, u = F.col("passed"), F.col("failed"), F.col("unknown")
    ratio = F.when(p + f + u == 0, F.when(F.col("not_applicable") > 0, 1.0).otherwise(0.0)).when(F.col("dimension") == "slot.inventory", 2 * p / (2 * p + f + 2 * u)).otherwise(p / (p + f + u))
    return rows.withColumn("score", F.round(F.col("weight") * ratio, 4))


def verdicts(assertions: DataFrame, weights: dict[str, float] = WEIGHTS, hard: tuple[str, ...] = HARD_FAILURES) -> DataFrame:
    """FAIL on a hard failure or a failed required assertion, UNKNOWN on a weighted dimension nobody looked at or any unknown, else PASS."""
    fail = F.bool_or((F.col("status") == "FAIL") & (F.col("required") | F.coalesce(F.col("failure_code").isin(*hard), F.lit(False))))
    seen = F.count_distinct(F.when(F.col("dimension").isin(*[k for k, v in weights.items() if v > 0]), F.col("dimension")))
    open_ = (seen < sum(v > 0 for v in weights.values())) | F.bool_or(F.col("status") == "UNKNOWN")
    return assertions.groupBy("pair_id").agg(F.when(fail, "FAIL").when(open_, "UNKNOWN").otherwise("PASS").alias("verdict"), open_.alias("provisional"))


def coverage_scores(assertions: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The weighted share of assertions that were observed."""
    rows = status_counts(assertions, weights)
    total = F.col("passed") + F.col("failed") + F.col("unknown") + F.col("not_applicable")
    share = F.when(total > 0, F.col("weight") * (total - F.col("unknown")) / total).otherwise(0.0)
    return rows.groupBy("pair_id").agg(F.round(F.sum(share) / sum(weights.values()), 6).alias("coverage"))


def view(dimension: str = "dimension") -> Column:
    return F.substring_index(dimension, ".", 1)


def view_scores(dimensions: DataFrame) -> DataFrame:
    """Totals per view and, with a null view, per pair; those of pairs add up those of views, so rows move by pair only."""
    sums = ["score", "weight", *STATUSES]
    views = dimensions.groupBy("pair_id", view().alias("view")).agg(*[F.sum(k).alias(k) for k in sums])
    pairs = views.groupBy("pair_id").agg(F.collect_list(F.struct("view", *sums)).alias("_views"), *[F.sum(k).alias(k) for k in sums])
    rows = pairs.select("pair_id", F.inline(F.concat("_views", F.array(F.struct(F.lit(None).cast("string").alias("view"), *sums)))))
    return rows.withColumn("score", F.round("score", 4))


def issues(assertions: DataFrame) -> DataFrame:
    """FAIL and UNKNOWN assertions of a pair, numbered ISS-0001 on by view, dimension and id."""
    order = W.partitionBy("pair_id").orderBy(view(), "dimension", "assertion_id")
    rows = assertions.where(F.col("status").isin("FAIL", "UNKNOWN"))
    return rows.select("pair_id", F.format_string("ISS-%04d", F.row_number().over(order)).alias("issue_id"), "assertion_id", F.when(F.col("status") == "FAIL", "error").otherwise("warning").alias("severity"))


def all_assertions(*parts: DataFrame) -> DataFrame:
    """The union of evaluators' assertions, and whether each id has exactly one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("single", F.count("*").over(W.partitionBy("pair_id", "assertion_id")) == 1)


def eval_reports(dimensions: DataFrame, verdict: DataFrame) -> DataFrame:
    """(pair_id, report): one JSON object per pair, dimensions in order; counts and codes only, no content."""
    fields = F.struct("dimension", "score", "passed", "failed", "unknown")
    rows = dimensions.groupBy("pair_id").agg(F.array_sort(F.collect_list(fields)).alias("dimensions"), F.round(F.sum("score"), 4).alias("total"))
    return rows.join(verdict, "pair_id").select("pair_id", F.to_json(F.struct("pair_id", "verdict", "total", "dimensions")).alias("report"))


def write_eval_report(reports: DataFrame, path: str) -> None:
    """The reports as text files of one JSON object a line."""
    reports.select("report").write.mode("overwrite").text(path)


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def render_markdown(rows: DataFrame, by: str, title: Column, cells: list[Column], order: str) -> DataFrame:
    """(by, markdown): a heading and a table for each group, rows in the given order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(c) for c in cells]), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(by).agg(F.array_join(lines, "\n").alias("body"), F.first(title).alias("title")).select(by, F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("markdown"))


def weighted_mean(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    return rows.groupBy(by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def alignment_summary(rows: DataFrame) -> DataFrame:
    """Counts by method as a map, and how many matched and missed."""
    by = rows.groupBy("pair_id", "method").agg(F.count("*").alias("n"), F.count_if("matched").alias("hit"))
    pairs = F.array_sort(F.collect_list(F.struct("method", "n")))
    return by.groupBy("pair_id").agg(F.map_from_entries(pairs).alias("methods"), F.sum("hit").alias("matched"), F.sum(F.col("n") - F.col("hit")).alias("missing"))


def majority_mapping(rows: DataFrame) -> DataFrame:
    """For each gold table the actual one it was aligned with most often, the first seen on ties."""
    n = rows.groupBy("pair_id", "gold_table", "actual_table").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    best = W.partitionBy("pair_id", "gold_table").orderBy(F.desc("n"), "first")
    return n.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("pair_id", "gold_table", "actual_table", "n")


def compare_atoms(gold: DataFrame, actual: DataFrame, tolerance: float) -> DataFrame:
    """Facts by id: PASS, FAIL or UNKNOWN with a reason; numbers may differ by the tolerance."""
    g = gold.select("pair_id", "atom_id", F.col("value").alias("g"), F.col("analyzable").alias("ga"))
    a = actual.select("pair_id", "atom_id", F.col("value").alias("a"), F.col("analyzable").alias("aa"))
    rows = g.join(a, ["pair_id", "atom_id"], "full")
    reason = F.when(F.col("ga").isNull(), "extra").when(F.col("aa").isNull(), "missing").when(~F.col("ga") | ~F.col("aa"), "not_analyzable").when(F.abs(F.col("g") - F.col("a")) > tolerance, "changed").otherwise("equal")
    return rows.select("pair_id", "atom_id", reason.alias("reason"), F.when(reason == "equal", "PASS").when(reason == "not_analyzable", "UNKNOWN").otherwise("FAIL").alias("status"))


def match_atoms(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """Gold facts that find an equal actual fact of their scope and dimension, each used once: the n-th takes the n-th."""
    key = ["scope", "dimension", "value"]
    n = F.row_number().over(W.partitionBy(*key).orderBy("atom_id"))
    g, a = gold.withColumn("n", n), actual.withColumn("n", n).withColumnRenamed("atom_id", "actual_id")
    return g.join(a, [*key, "n"], "left").select("scope", "dimension", "atom_id", "actual_id")


def style_diff(expected: DataFrame, actual: DataFrame, tolerances: dict[str, float], default: float = 0.0) -> DataFrame:
    """(owner, path, expected, actual) where a named property differs; numbers within their tolerance don't."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for p in tolerances.items() for x in p])[F.col("path")], F.lit(default))
    rows = expected.join(actual, ["owner", "path"], "left")
    equal = F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= limit, F.lit(False))
    return rows.where(~equal).select("owner", "path", "expected", "actual")


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a paragraph as one: a new island starts beyond the largest stop so far."""
    order = W.partitionBy("paragraph").orderBy("start", "stop")
    far = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(F.col("start") <= far, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    return rows.groupBy("paragraph", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def closure(props: DataFrame) -> DataFrame:
    """Per role: failed, unresolved and known-gap properties, completeness, and eligibility."""
    named = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("path"))))
    failed, gaps = F.col("state").isin("conflict", "unsupported"), F.col("state") == "missing"
    rows = props.groupBy("role").agg(named(failed).alias("failed"), named(F.col("state") == "unresolved").alias("unresolved"), named(gaps).alias("gaps"))
    bad = (F.size("failed") > 0) | (F.size("unresolved") > 0)
    return rows.select("role", "failed", "unresolved", "gaps", F.when(bad, "FAILED").otherwise("COMPLETE").alias("closure"), F.when(bad, "NOT_EVALUABLE").when(F.size("gaps") > 0, "INCOMPLETE_KNOWN_GAPS").otherwise("COMPLETE").alias("eligibility"))


def role_candidates(observations: DataFrame) -> DataFrame:
    """A role with one distinct digest is a candidate with its fields; several digests are a conflict."""
    rows = observations.groupBy("role").agg(F.count_distinct("digest").alias("digests"), F.min("digest").alias("digest"), F.sort_array(F.collect_set("field_id")).alias("fields"))
    return rows.select("role", F.when(F.col("digests") == 1, "candidate").otherwise("conflict").alias("kind"), F.when(F.col("digests") == 1, F.col("digest")).alias("digest"), "fields")


def ownership(facts: DataFrame) -> DataFrame:
    """How many facts each owner has, by dimension and over all (nulls), as a cube."""
    return facts.cube("owner", "dimension").agg(F.count("*").alias("n"), F.count_if("analyzable").alias("analyzable"), F.grouping_id().alias("level"))


def style_drift(occurrences: DataFrame, contracts: DataFrame, effective: DataFrame) -> DataFrame:
    """Per occurrence failed before unresolved before passed; numbers equal within 1e-9."""
    rows = occurrences.join(contracts, "style_id").join(effective, ["occurrence_id", "path"], "left")
    differs = F.coalesce(F.abs(F.col("expected") - F.col("actual")) > 1e-9, F.lit(False))
    return rows.groupBy("occurrence_id").agg(F.when(F.bool_or(differs), "failed").when(F.bool_or(F.col("actual").isNull()), "unresolved").otherwise("passed").alias("status"), F.count_if(differs).alias("differences"))
