"""Contracts and run reports: flattening, checks, evidence scopes and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT = "contract_id string, slots array<struct<slot_id:string,field_id:string,style_ref:string,required:boolean>>, styles array<struct<style_id:string,size:double>>"
REPORT = "version bigint, run_id string, status string, final_sha256 string"
HASH = "^[a-f0-9]{64}$"


def flatten_contracts(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slots, styles, violations) of nested contracts: each slot must name a style that its contract has."""
    rows = df.select(F.from_json(col, CONTRACT).alias("c")).select("c.*")
    slots = rows.select("contract_id", F.inline("slots"))
    styles = rows.select("contract_id", F.inline("styles"))
    known = styles.select("contract_id", F.col("style_id").alias("style_ref"))
    unresolved = slots.where("style_ref is not null").join(known, ["contract_id", "style_ref"], "left_anti").select("contract_id", "slot_id", F.lit("style_unresolved").alias("code"))
    without = slots.where("style_ref is null").select("contract_id", "slot_id", F.lit("style_missing").alias("code"))
    return slots, styles, unresolved.unionByName(without)


def check_run_reports(df: DataFrame, col: str) -> DataFrame:
    """Run reports as fields with the code of the first rule they break; only versions 1 and 2 are read."""
    rows = df.withColumn("_r", F.from_json(col, REPORT))
    f = lambda n: F.col(f"_r.{n}")
    code = (
        F.when(F.col("_r").isNull() | (f("version").isNull() & f("run_id").isNull()), "report_unreadable")
        .when(~F.coalesce(f("version").isin(1, 2), F.lit(False)), "report_version_unknown")
        .when(~F.coalesce(f("run_id").rlike("^run_[a-f0-9]{32}$"), F.lit(False)), "report_run_invalid")
        .when((f("status") == "completed") & f("final_sha256").isNull(), "report_hash_missing")
        .when(f("final_sha256").isNotNull() & ~f("final_sha256").rlike(HASH), "report_hash_invalid")
    )
    return rows.select(*df.columns, f("run_id").alias("run_id"), f("status").alias("status"), code.alias("code"))


def associate_evidence(refs: DataFrame) -> DataFrame:
    """(run_id, kind, value, status): objects need one known document, pages one known render; several scopes are a conflict."""
    known = refs.where(F.col("kind").isin("document", "render")).select("run_id", F.col("kind").alias("_k"), F.col("value").alias("scope")).distinct()
    need = F.when(F.col("kind") == "object", "document").when(F.col("kind") == "page", "render")
    rows = refs.where(F.col("kind").isin("object", "page")).withColumn("_k", need).join(known.withColumn("_found", F.lit(True)), ["run_id", "_k", "scope"], "left")
    status = F.when(F.count_distinct("scope") > 1, "conflict").when(F.count("scope") == 0, "partial").when(F.bool_and(F.col("_found").isNotNull()), "verified").otherwise("broken")
    return rows.groupBy("run_id", "kind", "value").agg(status.alias("status"))


def verify_run(observed: DataFrame, reported: DataFrame) -> DataFrame:
    """(run_id, status, code): hashes that events saw against the one a report states."""
    seen = observed.groupBy("run_id").agg(F.collect_set("sha256").alias("_seen"))
    rows = seen.join(reported.select("run_id", F.col("sha256").alias("_said")), "run_id", "full")
    n = F.coalesce(F.size("_seen"), F.lit(0))
    code: Column = F.when(F.col("_said").isNull() & (n <= 0), "nothing_known").when(F.col("_said").isNull(), "report_missing").when(n <= 0, "hash_not_observed").when(n > 1, "hashes_differ").when(~F.array_contains("_seen", F.col("_said")), "report_differs")
    status = F.when(code.isNull(), "verified").when(code.isin("hashes_differ", "report_differs"), "conflict").when(code == "nothing_known", "unavailable").otherwise("partial")
    return rows.select("run_id", status.alias("status"), code.alias("code"))


def subagents(events: DataFrame, tools: DataFrame) -> DataFrame:
    """(run_id, agent_id, status, elapsed_ms, reason): lifecycles of subagents, joined to the tool use that began them."""
    own = events.where("agent_id is not null").groupBy("run_id", "agent_id").agg(
        F.count_if(F.col("kind") == "subagent_stop").alias("_stops"),
        F.count_if(F.col("kind") == "subagent_start").alias("_starts"),
        F.collect_set("parent_tool_use_id").alias("_parents"),
        (F.max("offset_ms") - F.min("offset_ms")).alias("elapsed_ms"),
    )
    rows = own.withColumn("tool_use_id", F.when(F.size("_parents") == 1, F.try_element_at("_parents", F.lit(1)))).join(tools.select("run_id", "tool_use_id", F.lit(True).alias("_known")), ["run_id", "tool_use_id"], "left")
    reason = F.when(F.size("_parents") > 1, "parent_conflict").when(F.size("_parents") == 0, "parent_missing").when(F.col("_known").isNull(), "parent_unknown")
    status = F.when((F.col("_starts") > 0) & (F.col("_stops") > 0), "completed").when(F.col("_starts") > 0, "started").otherwise("unknown")
    return rows.select("run_id", "agent_id", status.alias("status"), "elapsed_ms", reason.alias("reason"))


def actor_edges(events: DataFrame, tools: DataFrame, agents: DataFrame) -> DataFrame:
    """(run_id, source_event_id, edge, target, status): events to their parent tool use and to their subagent; broken ones stay."""
    parents = events.where("parent_tool_use_id is not null").select("run_id", "source_event_id", F.lit("parent").alias("edge"), F.col("parent_tool_use_id").alias("target")).distinct()
    actors = events.where("agent_id is not null").select("run_id", "source_event_id", F.lit("actor").alias("edge"), F.col("agent_id").alias("target")).distinct()
    known = tools.select("run_id", F.lit("parent").alias("edge"), F.col("tool_use_id").alias("target")).unionByName(agents.select("run_id", F.lit("actor").alias("edge"), F.col("agent_id").alias("target"))).distinct()
    rows = parents.unionByName(actors).join(known.withColumn("_k", F.lit("verified")), ["run_id", "edge", "target"], "left")
    return rows.select("run_id", "source_event_id", "edge", "target", F.coalesce("_k", F.lit("broken")).alias("status"))


def align_regions(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """(pair_id, region_id, actual_region, status): by id, else the one region of the same owner at the same place."""
    ids = actual.groupBy("pair_id", "region_id").agg(F.count("*").alias("n_id"))
    places = actual.groupBy("pair_id", "owner", "location").agg(F.count("*").alias("n_at"), F.min("region_id").alias("at_region"))
    rows = gold.join(ids, ["pair_id", "region_id"], "left").join(places, ["pair_id", "owner", "location"], "left")
    by_id, by_place = F.col("n_id") == 1, F.col("n_id").isNull() & (F.col("n_at") == 1)
    status = F.when(by_id | by_place, "MATCHED").when(F.coalesce("n_id", "n_at") > 1, "AMBIGUOUS").otherwise("MISSING")
    return rows.select("pair_id", "region_id", F.when(by_id, F.col("region_id")).when(by_place, F.col("at_region")).alias("actual_region"), status.alias("status"))
