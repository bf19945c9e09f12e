"""Run telemetry: validated events, duplicates and conflicts, lifecycles, metrics, retention and comparison of runs."""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values an event may have; fixed values.
SOURCES = ("app", "sdk", "permission", "tool", "report")
PRIORITIES = ("P0", "P1", "P2")
USE_KINDS = ("tool_use", "server_tool_use")
TERMINAL_KINDS = ("tool_post", "tool_failure", "tool_result")
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
RUN_ID = r"^run_[a-f0-9]{32}$"
CODE = r"^[a-z][a-z0-9_]{0,63}$"
MOST_BYTES = 64 * 1024
#: Conditions of a comparison with their groups, and the groups that forbid one; fixed values.
CONDITIONS = {
    "source_sha256": "input", "template_sha256": "input", "requirements_sha256": "input", "backend": "runtime", "model": "runtime", "sdk_version": "runtime", "app_version": "runtime", "skill_name": "runtime", "knowledge_version": "runtime", "knowledge_digest": "runtime",
    "tool_version": "runtime", "officecli_version": "runtime", "renderer": "runtime", "renderer_version": "runtime", "route_fingerprint": "runtime", "routing_policy": "runtime", "task_authorization": "runtime", "validation_requirement": "validation", "final_evidence_category": "validation",
}
BLOCKING = ("input", "validation")
ROLES = ("main", "subagent", "app", "tool", "unknown")
#: Keys that an event's attributes may have; fixed values.
ATTRIBUTES = """
    answered api_error_status app_version artifact_published association attempt backend block_count cache_creation_input_tokens cache_hit
    cache_read_input_tokens check_count committed coverage_state dpi duration_api_ms errors events_dropped events_persisted evidence_count
    final_evidence_category final_sha256 focus focus_count focus_ref_count image_bytes image_count input_tokens issues knowledge_digest
    knowledge_version mode model num_turns object_count object_ref_count officecli_version operation_count operation_types overview option_count
    output_tokens page_count pages_available payload_bytes pdf_available provider provider_version region_count renderer renderer_version
    question_count reason_code report_run_id report_schema required_visual_coverage requirements_sha256 risk_count route_fingerprint routing_policy
    sdk_version side_effect_possible skill_name source_sha256 stop_hook_active stop_reason subagent_type subtype task_rule_count task_authorization
    task_ref template_sha256 terminal_reason tool_use_count tool_version total_cost_usd transcript_residual_count transcript_status
    validation_requirement warning_count warnings
""".split()
#: What values of attributes look like as JSON, and of references by kind; fixed patterns.
SAFE_VALUE = r'^(null|true|false|[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|"[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}"|\[([0-9]+(,[0-9]+)*)?\]|\["[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}"(,"[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}")*\])$'
OBJECT_ID, EVIDENCE_ID = r"^obj-[0-9a-f]{24}$", r"^[a-z0-9][a-z0-9_.:-]{0,255}$"
REFERENCES = {"document": r"^[0-9a-f]{64}$", "render": r"^[0-9a-f]{64}$", "object": OBJECT_ID, "evidence": EVIDENCE_ID, "page": r"^[1-9][0-9]*$"}
RANKS = {"verified": 0, "partial": 1, "broken": 2, "conflict": 3}


def rejection(most_bytes: int = MOST_BYTES, full: bool = False) -> Column:
    """The code of the first rule that an event breaks; null if it breaks none.

    full: also the rules on schema_version, actor(role, agent_id, agent_type), attributes (key, value as compact JSON),
    evidence_refs (kind, value, document_sha256, render_sha256) and error(code, origin), at their places in the order.
    """
    def bad(name, ok):
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"event_{name}_invalid"))

    optional = lambda c, pattern: F.col(c).isNull() | F.col(c).rlike(pattern)
    rules = [
        bad("run_id", F.col("run_id").rlike(RUN_ID)),
        bad("source_id", F.col("source_event_id").rlike(IDENTIFIER)),
        bad("sequence", F.col("source_sequence") >= 0),
        bad("time", F.col("observed_at").isNotNull() & (F.col("offset_ms") >= 0) & ~F.isnan("offset_ms") & (F.col("offset_ms") < float("inf"))),
        bad("source", F.col("source").isin(*SOURCES)),
        bad("priority", F.col("priority").isin(*PRIORITIES)),
        bad("kind", F.col("kind").rlike(CODE)),
        bad("status", optional("status", CODE)),
    ]
    named, counted = ["run_id", "source_event_id", "kind", "status", "tool_name"], [bad("duration", F.col("duration_ms").isNull() | (F.col("duration_ms") >= 0))]
    identified = optional("tool_use_id", IDENTIFIER) & optional("tool_name", IDENTIFIER)
    if full:
        rules = [bad("schema", F.col("schema_version") == 1), *rules, bad("actor", F.col("actor.role").isin(*ROLES))]
        identified = identified & optional("actor.agent_id", IDENTIFIER) & optional("actor.agent_type", IDENTIFIER)
        keys = F.transform("attributes", lambda x: x["key"])
        short = lambda v: ~v.startswith("[") | (F.json_array_length(v) <= 256)
        known = F.forall("attributes", lambda x: F.coalesce(x["key"].isin(*ATTRIBUTES) & x["value"].rlike(SAFE_VALUE) & short(x["value"]), F.lit(False)))
        counted.append(bad("attributes", F.col("attributes").isNull() | (F.size("attributes") <= 128) & known & (F.size(F.array_distinct(keys)) == F.size(keys))))
        sha = lambda v: v.isNull() | v.rlike(REFERENCES["document"])
        fits = lambda x: functools.reduce(Column.__or__, [(x["kind"] == k) & x["value"].rlike(p) for k, p in REFERENCES.items()])
        counted.append(bad("evidence", F.col("evidence_refs").isNull() | (F.size("evidence_refs") <= 256) & F.forall("evidence_refs", lambda x: F.coalesce(sha(x["document_sha256"]) & sha(x["render_sha256"]) & fits(x), F.lit(False)))))
        counted.append(bad("error", F.col("error").isNull() | F.col("error.code").rlike(CODE) & F.col("error.origin").rlike(CODE)))
        named += ["actor", "attributes", "evidence_refs", "error"]
    large = F.when(F.octet_length(F.to_json(F.struct(*named))) > most_bytes, F.lit("event_too_large"))
    return F.coalesce(*rules, bad("identifier", identified), *counted, large)


def validate_events(events: DataFrame, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a code); full: with the rules on actors, attributes, evidence and errors."""
    rows = events.withColumn("code", rejection(full=full))
    return rows.where("code is null").drop("code"), rows.where("code is not null")


def decode_events(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Stored JSON as fields; what doesn't parse keeps a fixed code instead of vanishing."""
    full = f"{schema}, _corrupt string"
    rows = df.withColumn("_e", F.from_json(col, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.select(*df.columns, *[F.col(f"_e.{n}").alias(n) for n in names], F.when(F.col("_e").isNull() | F.col("_e._corrupt").isNotNull(), "event_payload_invalid").alias("code"))


def project_safe(attributes: Column, allowed: list[str]) -> Column:
    """Of a map of attributes, those on the list whose values are safe identifiers."""
    return F.map_filter(attributes, lambda k, v: k.isin(*allowed) & v.rlike(IDENTIFIER))


#: Identifiers and codes that may leave a message; fixed patterns.
SAFE_ID, SAFE_CODE, SHA256 = r"^[\p{L}\p{N}_.:-]{1,256}$", r"^[\p{L}\p{N}_.:-]{1,128}$", r"^[0-9a-f]{64}$"


def project_private(messages: DataFrame, ids: tuple[str, ...] = (), codes: tuple[str, ...] = (), numbers: tuple[str, ...] = (), hashes: tuple[str, ...] = (), texts: tuple[str, ...] = (), known: dict[str, list[str]] | None = None) -> DataFrame:
    """What of messages may be kept: nothing but the named columns, each reduced by its kind.

    Ids and codes stay if they are safe identifiers (codes in lower case), numbers if they aren't negative, hashes if they
    are SHA-256, values of `known` columns if they are on their lists; others are null. A text becomes its number of
    characters and bytes, <name>_chars and <name>_bytes.
    """
    kept = lambda c, good: F.when(good, F.col(c)).alias(c)
    columns = [kept(c, F.col(c).rlike(SAFE_ID)) for c in ids]
    columns += [kept(c, F.col(c).rlike(SAFE_CODE) & (F.lower(c) == F.col(c))) for c in codes]
    columns += [kept(c, (F.col(c) >= 0) & ~F.isnan(F.col(c).cast("double"))) for c in numbers]
    columns += [kept(c, F.col(c).rlike(SHA256)) for c in hashes]
    columns += [kept(c, F.col(c).isin(*values)) for c, values in (known or {}).items()]
    for c in texts:
        columns += [F.char_length(c).cast("long").alias(f"{c}_chars"), F.octet_length(c).cast("long").alias(f"{c}_bytes")]
    return messages.select(*columns)


def action_counts(events: DataFrame, by: str, action: str) -> DataFrame:
    """name:count of each known action, by name, in one text."""
    n = events.groupBy(by, action).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(action), F.lit(":"), F.col("n").cast("string")))), ",").alias("actions"))


def exact_duplicates(events: DataFrame) -> DataFrame:
    """One row for each run and payload."""
    return events.withColumn("payload_sha256", F.sha2(F.to_json(F.struct(*sorted(events.columns))), 256)).dropDuplicates(["run_id", "payload_sha256"])


def index_events(events: DataFrame) -> DataFrame:
    """Rows of one identity (source, id, kind) that differ only in sequence and time are one; others are numbered variants of a conflict."""
    key = ["run_id", "source", "source_event_id", "kind"]
    rest = [c for c in sorted(events.columns) if c not in ("source_sequence", "observed_at", "offset_ms")]
    rows = events.withColumn("_meaning", F.sha2(F.to_json(F.struct(*rest)), 256))
    one = rows.groupBy(*key, "_meaning").agg(F.min("source_sequence").alias("source_sequence"), F.count("*").alias("copies"))
    variant = F.row_number().over(W.partitionBy(*key).orderBy("source_sequence", "_meaning"))
    return one.withColumn("variant", variant).withColumn("conflict", F.count("*").over(W.partitionBy(*key)) > 1).drop("_meaning")


def display_order(events: DataFrame) -> DataFrame:
    order = W.partitionBy("run_id").orderBy("offset_ms", "source_sequence", "source", "source_event_id", "kind")
    return events.withColumn("place", F.row_number().over(order))


def single(c: Column) -> Column:
    """The one distinct value of a group, null if there are several or none."""
    values = F.collect_set(c)
    return F.when(F.size(values) == 1, F.try_element_at(values, F.lit(1)))


def tool_lifecycles(events: DataFrame) -> DataFrame:
    """Per run and tool use: status, duration and its source, association status and reasons, in one aggregation.

    A duration is reported if all reports agree, else the estimated span from the first start to the last finish,
    hooks before stream messages. Details that differ are a conflict.
    """
    kind, status = F.col("kind"), F.col("status")
    denied = (kind == "permission_decision") & (status == "deny")
    use, terminal = kind.isin(*USE_KINDS), kind.isin(*TERMINAL_KINDS) | denied
    detail = F.collect_set(F.when(denied, "denied").when(kind.isin("tool_post", "tool_failure"), status))
    result = F.collect_set(F.when(kind == "tool_result", status))
    reported = F.collect_set(F.when(kind.isin(*TERMINAL_KINDS), F.round("duration_ms", 9)))
    rows = events.where("tool_use_id is not null").groupBy("run_id", "tool_use_id").agg(
        detail.alias("detail"),
        result.alias("result"),
        reported.alias("reported"),
        F.count_if((F.col("source") == "sdk") & use).alias("uses"),
        F.count_if(use).alias("any_use"),
        F.count_if(terminal).alias("terminals"),
        F.min(F.when(kind == "tool_pre", F.col("offset_ms"))).alias("hook_start"),
        F.min(F.when(use, F.col("offset_ms"))).alias("sdk_start"),
        F.max(F.when(kind.isin("tool_post", "tool_failure") | denied, F.col("offset_ms"))).alias("hook_finish"),
        F.max(F.when(kind == "tool_result", F.col("offset_ms"))).alias("sdk_finish"),
        single(F.col("tool_name")).alias("tool_name"),
        F.size(F.collect_set("tool_name")).alias("names"),
    )
    conflict = (F.size("detail") > 1) | ((F.size("detail") == 0) & (F.size("result") > 1))
    start, finish = F.coalesce("hook_start", "sdk_start"), F.coalesce("hook_finish", "sdk_finish")
    reasons = F.array_compact(F.array(F.when(F.col("names") > 1, "tool_name_conflict"), F.when(conflict, "tool_status_conflict"), F.when((F.col("uses") > 0) & (F.col("terminals") == 0), "tool_terminal_missing"), F.when(F.col("uses") == 0, "tool_use_missing")))
    return rows.select(
        "run_id",
        "tool_use_id",
        "tool_name",
        F.when(conflict, "conflict").otherwise(F.coalesce(F.try_element_at("detail", F.lit(1)), F.try_element_at("result", F.lit(1)), F.when(F.col("any_use") > 0, "started"), F.lit("unknown"))).alias("status"),
        F.when(F.size("reported") == 1, F.try_element_at("reported", F.lit(1))).when(F.size("reported") == 0, F.greatest(F.lit(0.0), finish - start)).alias("duration_ms"),
        F.when(F.size("reported") == 1, "reported").when((F.size("reported") == 0) & start.isNotNull() & finish.isNotNull(), "estimated").otherwise("unknown").alias("duration_source"),
        F.when(conflict | (F.col("names") > 1), "conflict").when((F.col("uses") == 0) & (F.col("terminals") > 0), "broken").when((F.col("uses") == 0) | (F.col("terminals") == 0), "partial").otherwise("verified").alias("association"),
        reasons.alias("reasons"),
    )


def tool_edges(tools: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, tool_use_id, source_event_id, status): each terminal event with its use; broken where the use is missing."""
    ends = events.where(F.col("kind").isin(*TERMINAL_KINDS) & F.col("tool_use_id").isNotNull()).select("run_id", "tool_use_id", "source_event_id")
    used = tools.where(~F.array_contains("reasons", "tool_use_missing")).select("run_id", "tool_use_id", F.lit("verified").alias("status"))
    return ends.join(used, ["run_id", "tool_use_id"], "left").withColumn("status", F.coalesce("status", F.lit("broken")))


def nearest_rank(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """(by, rank_value): the nearest-rank quantile of each group's values that aren't null, exactly, without a group's values in one place.

    Values are counted in bins of one hundredth of their size, in order; only the bin that holds the rank is looked into.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v"))
    own = own.withColumn("_bin", F.signum("_v") * F.floor(F.log(1 + F.abs("_v")) * 100))
    counts = own.groupBy("_by", "_bin").agg(F.count("*").alias("_n"))
    order = W.partitionBy("_by").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_rank", F.greatest(F.ceil(F.lit(share) * F.sum("_n").over(W.partitionBy("_by"))), F.lit(1)))
    held = counts.where("_upto - _n < _rank and _rank <= _upto").select("_by", "_bin", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_left"))
    near = own.join(held, ["_by", "_bin"]).groupBy("_by", "_v", "_left").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("_by").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    return near.withColumn("_upto", upto).where("_upto >= _left").groupBy("_by").agg(F.min("_v").alias("rank_value")).withColumnRenamed("_by", by)


def tool_stats(tools: DataFrame, complete: Column) -> DataFrame:
    """Per tool: calls, outcomes, and total, mean and nearest-rank p95 durations, those only where all are known and the run is complete."""
    known = F.bool_and(complete & F.col("duration_ms").isNotNull())
    own = tools.groupBy("tool_name").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "needs_input").alias("needs_input"),
        F.count_if(F.col("status").isin("error", "denied", "conflict")).alias("errors"),
        F.when(known, F.round(F.sum("duration_ms"), 3)).alias("total_ms"),
        F.when(known, F.round(F.avg("duration_ms"), 3)).alias("mean_ms"),
        known.alias("_known"),
    )
    p95 = nearest_rank(tools, "tool_name", "duration_ms", 0.95).select(F.col("tool_name").alias("_tool"), "rank_value")
    rows = own.join(p95, F.col("tool_name").eqNullSafe(F.col("_tool")), "left")
    return rows.select("tool_name", "calls", "ok", "needs_input", "errors", "total_ms", "mean_ms", F.when(F.col("_known"), F.col("rank_value")).alias("p95_ms"))


def run_metrics(events: DataFrame, tools: DataFrame) -> DataFrame:
    """Measures of a run; a sum with an unknown part is null, never smaller than it should be."""
    own = events.groupBy("run_id").agg(F.count("*").alias("events"), F.count_distinct("source").alias("sources"), F.count_if(F.col("status") == "error").alias("errors"), F.max("offset_ms").alias("elapsed_ms"))
    used = tools.groupBy("run_id").agg(F.count("*").alias("tools"), F.when(F.bool_and(F.col("duration_ms").isNotNull()), F.round(F.sum("duration_ms"), 3)).alias("tool_ms"))
    return own.join(used, "run_id", "left")


#: Sums of what a run's results report; fixed values.
REPORTED = {"agent_turns": "num_turns", "input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_creation_input_tokens": "cache_creation_input_tokens", "cache_read_input_tokens": "cache_read_input_tokens", "total_cost_usd": "total_cost_usd"}


def run_measures(events: DataFrame, tools: DataFrame, subagents: DataFrame, coverage: DataFrame, render: str = "render", review: str = "visual_review", question: str = "ask_user") -> DataFrame:
    """(run_id, measure, value, source): 18 measures of each run; source is reported, estimated or unknown, whose value is null, never 0.

    events: (run_id, kind, tool_name, status, duration_ms, attributes map of texts, pages array of (render, page));
    tools: (run_id, tool_name, status); subagents: (run_id); coverage: (run_id, coverage). Reported ones are sums over
    results, or a value that all reports agree on. Derived ones need a complete run, and every part of a sum known.
    """
    number = lambda c: F.col("attributes")[c].try_cast("double")
    is_kind = lambda k: F.col("kind") == k
    of = lambda cond, value: F.when(cond, value)
    post = is_kind("tool_post")
    rendered, reviewed = post & (F.col("tool_name") == render), post & (F.col("tool_name") == review)
    hit = F.col("attributes")["cache_hit"].try_cast("boolean")
    agreed = lambda cond, value: F.when(F.count_distinct(of(cond, value)) == 1, F.min(of(cond, value)))
    every = lambda cond, known, value: F.when(F.count_if(cond & known.isNotNull()) == F.count_if(cond), F.coalesce(F.sum(of(cond, value)), F.lit(0.0)))
    own = events.groupBy("run_id").agg(
        agreed(is_kind("run_finished"), F.round("duration_ms", 9)).alias("total_duration_ms"),
        agreed(is_kind("conversion_report"), number("warning_count")).alias("warnings"),
        *[F.sum(of(is_kind("sdk_result"), number(c))).alias(name) for name, c in REPORTED.items()],
        every(rendered, hit, hit.cast("double")).alias("cache_hits"),
        every(rendered, hit, (~hit).cast("double")).alias("render_executions"),
        every(reviewed, number("image_count"), number("image_count")).alias("image_count"),
        every(reviewed, number("image_bytes"), number("image_bytes")).alias("image_bytes"),
        F.count_if(is_kind("permission_decision") & (F.col("status") == "deny")).alias("permission_denials"),
        F.greatest(F.count_if(is_kind("backend_started")) - 1, F.lit(0)).alias("retries"),
        F.bool_or(F.exists("pages", lambda x: x["render"].isNull())).alias("_loose"),
    )
    pages = events.select("run_id", F.inline("pages")).where("render is not null").groupBy("run_id").agg(F.count_distinct("render", "page").alias("_pages"))
    used = tools.groupBy("run_id").agg(F.count("*").alias("tool_calls"), F.count_if(F.col("tool_name") == question).alias("user_questions"), F.count_if(F.col("status").isin("error", "denied", "conflict")).alias("errors"))
    rows = own.join(pages, "run_id", "left").join(used, "run_id", "left").join(subagents.groupBy("run_id").agg(F.count("*").alias("subagents")), "run_id", "left").join(coverage.select("run_id", (F.col("coverage") == "complete").alias("_whole")), "run_id", "left")
    rows = rows.withColumn("pages_viewed", F.coalesce("_pages", F.when(~F.coalesce("_loose", F.lit(False)), F.lit(0))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = rows.select("*", *[zero(c).alias(f"_{c}") for c in ("tool_calls", "user_questions", "errors", "subagents")])
    reported = {c: F.col(c) for c in ("total_duration_ms", "warnings", *REPORTED)}
    derived = {c: F.col(c) for c in ("cache_hits", "render_executions", "pages_viewed", "image_count", "image_bytes", "permission_denials", "retries")} | {c: F.col(f"_{c}") for c in ("tool_calls", "user_questions", "errors", "subagents")}
    row = lambda name, value, source: F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"), F.when(value.isNull(), "unknown").otherwise(source).alias("source"))
    listed = [row(n, v, "reported") for n, v in reported.items()] + [row(n, F.when(F.coalesce("_whole", F.lit(False)), v), "estimated") for n, v in derived.items()]
    return rows.select("run_id", F.inline(F.array(*listed)))


def run_result(events: DataFrame, status: Column) -> DataFrame:
    """The single value that a run's events agree on, else unknown with a conflict flag."""
    values = F.array_sort(F.collect_set(status))
    return events.groupBy("run_id").agg(values.alias("_v")).select("run_id", F.when(F.size("_v") == 1, F.try_element_at("_v", F.lit(1))).otherwise("unknown").alias("result"), (F.size("_v") > 1).alias("conflict"))


def run_coverage(events: DataFrame) -> DataFrame:
    """Which sources a run lacks; unavailable if only reports came, degraded if any lacks."""
    own = events.groupBy("run_id").agg(F.collect_set("source").alias("_s"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(s) for s in SOURCES]), F.col("_s")))
    rows = own.select("run_id", missing.alias("missing"), "_s")
    return rows.select("run_id", F.array_join("missing", ",").alias("missing"), F.when(F.array_except("_s", F.array(F.lit("report"))) == F.array().cast("array<string>"), "unavailable").when(F.size("missing") > 0, "degraded").otherwise("complete").alias("coverage"))


#: Events that a run must have, with what is missing without them; fixed values.
MILESTONES = {"run_started": "app_run_start", "run_finished": "app_run_terminal", "conversion_report": "report_event"}


def observation_coverage(runs: DataFrame, events: DataFrame, associations: DataFrame, receipts: DataFrame, sanitized: DataFrame, rejected: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(run_id, state, missing, failures, dropped) of each of the runs(run_id): what of it was observed, and what went wrong.

    events(run_id, kind), associations(run_id, status, association, reasons) of tools and subagents, receipts(run_id,
    source, state, failure_code) of adapters, sanitized(run_id, status, reason_code), rejected(run_id), conflicts(run_id,
    code). Missing: adapters without a receipt or with another state than available, milestones, and what associations
    that aren't verified lack (denied ones aside). Failures: codes of receipts and drops, contradicting receipts, conflicts
    and rejections. unavailable without any event but reports, degraded with anything missing, failed or dropped, else
    complete. dropped is null for a run without receipts. Everything is a row (run_id, missing or failure) of one grouping.
    """
    none = F.lit(None).cast("string")
    note = lambda df, missing=none, failure=none: df.select("run_id", missing.alias("missing"), failure.alias("failure"))
    states = receipts.groupBy("run_id", "source").agg(F.collect_set("state").alias("states"))
    sources = runs.select("run_id", F.explode(F.array(*[F.lit(x) for x in SOURCES])).alias("source")).join(states, ["run_id", "source"], "left")
    bad = F.when(F.col("states").isNull(), F.concat("source", F.lit("_adapter_receipt"))).when(F.col("states") != F.array(F.lit("available")), F.concat("source", F.lit("_adapter")))
    seen = runs.select("run_id").join(events.groupBy("run_id").agg(F.collect_set("kind").alias("kinds")), "run_id", "left")
    lacks = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(F.array_contains("kinds", kind), F.lit(False)), F.lit(code)) for kind, code in MILESTONES.items()])))
    loose = associations.where("association <> 'verified' and not (status <=> 'denied')")
    notes = [
        note(sources, bad, F.when(F.size("states") > 1, "observer_adapter_receipt_conflict")),
        note(receipts.where("failure_code is not null"), failure=F.col("failure_code")),
        note(sanitized.where("status = 'dropped'"), failure=F.col("reason_code")),
        seen.select("run_id", lacks.alias("missing"), none.alias("failure")),
        loose.select("run_id", F.explode(F.filter("reasons", lambda r: r.endswith("_missing"))).alias("missing"), none.alias("failure")),
        note(loose.where("association = 'conflict'"), failure=F.lit("observer_association_conflict")),
        note(rejected, failure=F.lit("observer_event_rejected")),
        note(conflicts, failure=F.col("code")),
    ]
    found = functools.reduce(DataFrame.unionByName, notes).groupBy("run_id").agg(F.array_sort(F.collect_set("missing")).alias("missing"), F.array_sort(F.collect_set("failure")).alias("failures"))
    drops = sanitized.where("status = 'dropped'").groupBy("run_id").agg(F.count("*").alias("n"))
    rows = seen.join(found, "run_id", "left").join(drops, "run_id", "left").join(receipts.select("run_id", F.lit(True).alias("told")).distinct(), "run_id", "left")
    empty = F.array().cast("array<string>")
    missing, failures = F.coalesce("missing", empty), F.coalesce("failures", empty)
    other = F.size(F.array_except(F.coalesce("kinds", empty), F.array(F.lit("conversion_report")))) > 0
    state = F.when(~other, "unavailable").when((F.size(missing) > 0) | (F.size(failures) > 0) | F.col("n").isNotNull(), "degraded").otherwise("complete")
    return rows.select("run_id", state.alias("state"), missing.alias("missing"), failures.alias("failures"), F.when(F.col("told"), F.coalesce("n", F.lit(0))).alias("dropped"))


def worst_status(rows: DataFrame, by: str, status: str) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for p in RANKS.items() for x in p])[F.col(status)]
    return rows.groupBy(by).agg(F.max_by(status, rank).alias("worst"))


def reported_values(events: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(run_id, key, values, available): distinct values of each key in order."""
    listed = events.select("run_id", F.explode(F.create_map(*[x for k, c in keys.items() for x in (F.lit(k), c.cast("string"))])).alias("key", "value"))
    return listed.groupBy("run_id", "key").agg(F.sort_array(F.collect_set("value")).alias("values")).withColumn("available", F.size("values") > 0)


def history_revision(runs: DataFrame) -> DataFrame:
    """One digest per page of runs (here by status); it changes if any row does.

    Rows are digested in order in each of 256 buckets by their run, and then the buckets' digests, so no page is gathered whole.
    """
    bucket = F.substring(F.md5("run_id"), 1, 2).alias("bucket")
    lines = F.array_sort(F.collect_list(F.concat_ws("|", "run_id", F.col("event_count").cast("string"))))
    parts = runs.groupBy("status", bucket).agg(F.sha2(F.concat_ws("\n", lines), 256).alias("digest"))
    return parts.groupBy("status").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "digest")))), 256).alias("revision"))


def run_state(events: DataFrame) -> DataFrame:
    """First and last offsets, latest status, counts and bytes per run; also as a stream, as it is one aggregation."""
    return events.groupBy("run_id").agg(
        F.min("offset_ms").alias("first_ms"),
        F.max("offset_ms").alias("last_ms"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.struct("offset_ms", "source_sequence", "source_event_id"))).alias("status"),
        F.count("*").alias("event_count"),
        F.sum("size").alias("event_bytes"),
    )


def enforce_quota(events: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Keeps each run's events by priority and arrival while their number and bytes fit; `kept` says which."""
    order = W.partitionBy("run_id").orderBy("priority", "source_sequence", "source_event_id", "kind").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("kept", (F.count("*").over(order) <= most) & (F.sum("size").over(order) <= most_bytes))


def evict_by_priority(events: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Adds `kept`: events arrive in order; where a run is full, the oldest of the lowest class below the newcomer's goes, again and again.

    Where none is left below it, the newcomer goes itself. Classes are P0, P1 and P2, the first the highest; P0 is never
    evicted. An event without one of these classes or without a size is not kept. A run's events stream by in order; a
    task holds those that are kept, so at most `most` of a run, as Arrow rows whose columns pass through as they are.
    """
    names = [f.name for f in events.schema.fields]
    order = ["run_id", "source_sequence", "source_event_id", "kind"]
    at = [names.index(c) for c in ("run_id", "priority", "size")]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, bytes_held, held, rows = None, 0, {c: deque() for c in PRIORITIES}, None  # held: numbers of rows

        def taken(which: list[int], kept: bool) -> Iterator[pa.RecordBatch]:
            for part in rows.take(pa.array(which, pa.int64())).to_batches() if which else ():
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([kept] * len(part))], names=[*names, "kept"])

        for batch in batches:
            new = pa.Table.from_batches([batch.rename_columns(names)])
            start = 0 if rows is None else rows.num_rows
            rows = pa.concat_tables([*([] if rows is None else [rows]), new])
            stay, go = [], []
            for i, (its_run, own, size) in enumerate(zip(*(batch.column(k).to_pylist() for k in at), strict=True), start):
                if its_run != run:
                    for queue in held.values():
                        stay += queue
                        queue.clear()
                    run, bytes_held = its_run, 0
                if own not in held or size is None:
                    go.append(i)
                    continue
                full = lambda s=size: sum(map(len, held.values())) >= most or bytes_held + s > most_bytes
                while full() and (lower := next((c for c in ("P2", "P1") if c > own and held[c]), None)):
                    gone = held[lower].popleft()
                    bytes_held -= sizes[gone] if gone < start else batch.column(at[2])[gone - start].as_py()
                    go.append(gone)
                if full():
                    go.append(i)
                else:
                    held[own].append(i)
                    bytes_held += size
            yield from taken(stay, True)
            yield from taken(go, False)
            left = sorted(i for queue in held.values() for i in queue)
            place = {i: k for k, i in enumerate(left)}
            rows = rows.take(pa.array(left, pa.int64())).combine_chunks()
            sizes = rows.column(at[2]).to_pylist()
            held = {c: deque(place[i] for i in queue) for c, queue in held.items()}
        if rows is not None:
            yield from taken([i for queue in held.values() for i in queue], True)

    dealt = events.repartition("run_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(decide, T.StructType([*events.schema.fields, T.StructField("kept", T.BooleanType())]))


def retain(runs: DataFrame, now_ms: float, days: int, newest: int) -> DataFrame:
    """Runs that stay: active ones, and completed ones that are young enough and among the newest."""
    top = runs.where("completed_ms is not null").orderBy(F.desc("completed_ms"), F.desc("run_id")).limit(newest).select("run_id")  # a top-k
    done = runs.where(F.col("completed_ms") >= now_ms - days * 86_400_000).join(top, "run_id", "left_semi")
    return runs.where("completed_ms is null").unionByName(done)


def prune_bytes(runs: DataFrame, budget: int, slot_ms: int = 86_400_000) -> DataFrame:
    """Completed runs that go, oldest first, until what is left fits the budget; running sums go by slots of time."""
    total = runs.agg(F.sum("event_bytes")).first()[0] or 0
    done = runs.where("completed_ms is not null").withColumn("_slot", F.floor(F.col("completed_ms") / slot_ms))
    slots = done.groupBy("_slot").agg(F.sum("event_bytes").alias("_sum"))
    earlier = slots.withColumn("_earlier", F.coalesce(F.sum("_sum").over(W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")  # a row per slot of time
    order = W.partitionBy("_slot").orderBy("completed_ms", "run_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_earlier") + F.coalesce(F.sum("event_bytes").over(order), F.lit(0))
    return done.join(earlier, "_slot").withColumn("_before", before).where(F.lit(total) - F.col("_before") > budget).drop("_slot", "_earlier", "_before")


def compare_runs(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_run, right_run, metric, left_value, right_value, delta): metrics(run_id, metric, value) of each pair of runs side by side.

    A delta only where both are known; a metric that one run lacks has a null there.
    """
    wanted = pairs.select("left_run", "right_run")
    side = lambda name: wanted.join(metrics.select(F.col("run_id").alias(f"{name}_run"), "metric", F.col("value").alias(f"{name}_value")), f"{name}_run")
    both = side("left").join(side("right"), ["left_run", "right_run", "metric"], "full")
    return both.select("left_run", "right_run", "metric", "left_value", "right_value", (F.col("right_value") - F.col("left_value")).alias("delta"))


def compare_conditions(attributes: DataFrame, pairs: DataFrame, conditions: dict[str, str] = CONDITIONS, blocking: tuple[str, ...] = BLOCKING) -> DataFrame:
    """(left_run, right_run, matched, different, unknown, comparability, conclusion, winner) over attributes(run_id, key, value).

    A condition is unknown where a run has no value, a match where both have the same values. A difference in a blocking
    group is not_comparable; else all matched is strict, and the rest conditional. A conclusion needs comparable runs with
    every blocking condition known; there is never a winner.
    """
    groups = F.create_map(*[F.lit(x) for p in conditions.items() for x in p])
    own = attributes.where(F.col("key").isin([*conditions]) & F.col("value").isNotNull()).groupBy("run_id", "key").agg(F.sort_array(F.collect_set("value")).alias("values"))
    rows = pairs.select("left_run", "right_run", F.explode(F.array(*[F.lit(c) for c in conditions])).alias("key"))
    for name in ("left", "right"):
        rows = rows.join(own.select(F.col("run_id").alias(f"{name}_run"), "key", F.col("values").alias(f"{name}_values")), [f"{name}_run", "key"], "left")
    state = F.when(F.col("left_values").isNull() | F.col("right_values").isNull(), "unknown").when(F.col("left_values") == F.col("right_values"), "match").otherwise("different")
    rows = rows.withColumn("state", state).withColumn("blocks", groups[F.col("key")].isin(*blocking))
    listed = lambda name: F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == name, F.col("key")))), ",")
    any_of = lambda name: F.bool_or(F.col("blocks") & (F.col("state") == name))
    out = rows.groupBy("left_run", "right_run").agg(listed("match").alias("matched"), listed("different").alias("different"), listed("unknown").alias("unknown"), F.bool_and(F.col("state") == "match").alias("_all"), any_of("different").alias("_apart"), any_of("unknown").alias("_dark"))
    level = F.when(F.col("_apart"), "not_comparable").when(F.col("_all"), "strict").otherwise("conditional")
    return out.select("left_run", "right_run", "matched", "different", "unknown", level.alias("comparability"), F.when(F.col("_apart") | F.col("_dark"), "not_allowed").otherwise("differences_only").alias("conclusion"), F.lit(None).cast("string").alias("winner"))


def overhead(samples: DataFrame) -> DataFrame:
    """Whether p95 increments of paired on and off samples fit the budgets: 3 % of the base or 0.25 s, 5 % CPU, 64 MiB."""
    pairs = samples.groupBy("pair").agg(*[F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{c}_{m}") for m in ("on", "off") for c in ("wall", "cpu", "rss")])
    wanted = {"wall": "wall_on - wall_off", "base": "wall_off", "cpu": "(cpu_on - cpu_off) / cpu_off", "rss": "rss_on - rss_off"}
    long = pairs.where("wall_on is not null and wall_off is not null").select(F.explode(F.create_map(*[x for k, e in wanted.items() for x in (F.lit(k), F.expr(e).cast("double"))])).alias("metric", "value"))
    got = nearest_rank(long, "metric", "value", 0.95).agg(*[F.max(F.when(F.col("metric") == k, F.col("rank_value"))).alias(k) for k in wanted])
    return got.select("wall", "cpu", "rss", ((F.col("wall") <= F.greatest(0.03 * F.col("base"), F.lit(0.25))) & (F.col("cpu") <= 0.05) & (F.col("rss") <= 64.0 * 1024 * 1024)).alias("passed"))


def usage_merge(rows: DataFrame, by: str) -> DataFrame:
    """Numbers of a usage map summed, other values from the first row that has them."""
    number = F.col("value").try_cast("double")
    merged = rows.groupBy(by, "key").agg(F.sum(number).alias("_n"), F.min_by("value", "seq").alias("_first"), F.bool_and(number.isNotNull()).alias("_all"))
    return merged.select(by, "key", F.when(F.col("_all"), F.col("_n").cast("long").cast("string")).otherwise(F.col("_first")).alias("value"))


def batch_summary(batches: DataFrame, by: str) -> DataFrame:
    """Batches, valid ones, distinct sessions, and whether all are valid."""
    valid = F.col("backend").isNotNull() & F.col("session").isNotNull()
    return batches.groupBy(by).agg(F.count("*").alias("batches"), F.count_if(valid).alias("valid"), F.count_distinct("session").alias("sessions"), F.bool_and(valid).alias("complete"))


def warning_labels(rows: DataFrame, by: str) -> DataFrame:
    """Distinct labels in the order they were first seen."""
    first = rows.groupBy(by, "label").agg(F.min("seq").alias("seq"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda x: x["label"]).alias("labels"))


def latest(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """The last row of each group."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")


def list_runs(runs: DataFrame, n: int) -> DataFrame:
    """The newest runs by completion or last sight; a top-k."""
    return runs.orderBy(F.desc(F.coalesce("completed_ms", "last_ms")), "run_id").limit(n)
