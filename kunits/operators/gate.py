"""The review gate: classification, handling groups, counters, the decision ledger."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.functions.text import clean_text

PASS, NOTICE, MANUAL = "automatic_pass", "automatic_pass_with_notice", "mandatory_human_handling"
HARD_RISKS = ("project_ownership_conflict", "critical_fact_conflict", "missing_or_unverifiable_evidence", "unsupported_model_fact", "company_reuse_promotion")
NOTICES = ("category_unresolved", "noncritical_difference", "route_incomplete")
#: Differences that block (fixed values).
BLOCKING = ("missing_in_evidence", "unsupported_addition", "conflict", "ambiguous_conversion", "strengthened_obligation", "weakened_obligation", "changed_obligation", "invented_condition", "removed_condition_or_exception")
#: What to do about each hard risk (fixed values).
ACTIONS = {
    "project_ownership_conflict": "请选择该资料实际所属的项目；如证据互相冲突，请分别处理。", "critical_fact_conflict": "请对照原文确认金额、日期、单位或状态，并选择正确事实。",
    "missing_or_unverifiable_evidence": "请补充可定位的原文证据，或退回该条目。", "unsupported_model_fact": "请删除来源没有写明的内容，或提供支持它的原文证据。",
    "company_reuse_promotion": "请确认是否把这条项目资料提升为公司可复用知识。",
}


def verifiable(quote: Column, block_id: Column, scheme: Column, value: Column) -> Column:
    """Whether evidence has a quote, a block and a place."""
    full = F.lit(True)
    for c in (quote, block_id, scheme, value):
        full = full & (clean_text(c, 4000) != "")
    return full


def critical_signature(facts: dict[str, Column], explicit: Column | None = None) -> Column:
    """Signature of critical facts (sorted lists as JSON): an explicit one, else a hash, else empty."""
    given = F.array_compact(F.array(*(F.when(F.size(F.coalesce(v, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f'"{k}":'), F.to_json(F.array_sort(F.array_distinct(v))))) for k, v in facts.items())))
    made = F.when(F.size(given) > 0, F.substring(F.sha2(F.concat(F.lit("{"), F.array_join(given, ","), F.lit("}")), 256), 1, 20)).otherwise("")
    return made if explicit is None else F.coalesce(F.nullif(clean_text(explicit, 300), F.lit("")), made)


def classify(candidates: DataFrame) -> DataFrame:
    """Adds hard_risks, notices (both sorted) and outcome. Confidence has no part in it.

    Needs: review_reasons, evidence_ok, reusable, difference_status, library,
    directory_category, document_role, route_reasons.
    """
    none = F.array().cast("array<string>")
    reasons, route = F.coalesce("review_reasons", none), F.coalesce("route_reasons", none)
    has = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    critical = has("critical_fact_conflict") | F.coalesce(F.col("difference_status").isin(*BLOCKING), F.lit(False))
    hard = F.array_compact(F.array(
        F.when(has("ambiguous_project", "conflicting_project_ownership") | F.array_contains(route, "ambiguous_project"), "project_ownership_conflict"),
        F.when(critical, "critical_fact_conflict"),
        F.when(has("missing_evidence") | ~F.coalesce("evidence_ok", F.lit(False)), "missing_or_unverifiable_evidence"),
        F.when(has("unsupported_invented_facts", "unsupported_model_fact"), "unsupported_model_fact"),
        F.when(F.col("reusable").eqNullSafe(True) | has("reuse_promotion"), "company_reuse_promotion"),
    ))
    open_route = F.col("library").isNull() | F.col("directory_category").isNull() | F.coalesce("document_role", F.lit("unknown")).isin("unknown", "")
    notices = F.array_compact(F.array(F.when(has("ambiguous_category"), "category_unresolved"), F.when(~critical & has("conflicting_facts"), "noncritical_difference"), F.when(open_route, "route_incomplete")))
    rows = candidates.withColumns({"hard_risks": F.array_sort(hard), "notices": F.array_sort(notices)})
    return rows.withColumn("outcome", F.when(F.size("hard_risks") > 0, MANUAL).when(F.size("notices") > 0, NOTICE).otherwise(PASS))


def handling_groups(classified: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """group_id, root_cause, action, candidate_ids (sorted): mandatory cases by document, risk and conflict."""
    rows = classified.select(id_col, "candidate_id", F.explode("hard_risks").alias("root_cause"), F.coalesce("conflict_signature", F.lit("")).alias("signature"))
    part = F.when(F.col("root_cause") == "critical_fact_conflict", F.coalesce(F.nullif("signature", F.lit("")), F.col("candidate_id"))).otherwise("")
    grouped = rows.withColumn("part", part).groupBy(id_col, "root_cause", "part").agg(F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids"))
    key = F.concat_ws(":", F.col(id_col).cast("string"), "root_cause", F.nullif("part", F.lit("")))
    act = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    return grouped.select(F.concat(F.lit("review-"), F.substring(F.sha2(F.to_json(F.array(key)), 256), 1, 24)).alias("group_id"), id_col, "root_cause", act[F.col("root_cause")].alias("action"), "candidate_ids")


def counters(classified: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: generated, auto_passed, notices, needs_handling, handling_groups."""
    c = lambda outcome: F.count_if(F.col("outcome") == outcome)
    own = classified.agg(F.count("*").alias("generated"), c(PASS).alias("auto_passed"), c(NOTICE).alias("notices"), c(MANUAL).alias("needs_handling"))
    return own.join(groups.agg(F.count("*").alias("handling_groups")))  # one row each


def plain_summary(counts: DataFrame) -> DataFrame:
    n = lambda c: F.col(c).cast("string")
    first = F.concat(F.lit("本次生成 "), n("generated"), F.lit(" 条：自动通过 "), n("auto_passed"), F.lit(" 条，通过并提示 "), n("notices"), F.lit(" 条，需要处理 "), n("needs_handling"), F.lit(" 条。"))
    then = F.when(F.col("handling_groups") == 0, " 无需逐条确认。").otherwise(F.concat(F.lit(" 请按 "), n("handling_groups"), F.lit(" 个问题组处理：确认正确内容、补充证据，或退回有问题的条目。")))
    return counts.select(F.concat(first, then).alias("summary"))


def run(candidates: DataFrame, enabled: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified, groups, counters); without the switch they are empty and zero."""
    classified = classify(candidates if enabled else candidates.where(F.lit(False)))
    if "conflict_signature" not in classified.columns:
        classified = classified.withColumn("conflict_signature", F.lit(""))
    groups = handling_groups(classified)
    return classified, groups, counters(classified, groups)


#: Fields of a ledger entry that its hash covers, in order (fixed values).
LEDGER = ("schema_version", "decision_id", "decided_at", "decided_by", "source_document_id", "group_id", "decision", "candidate_ids", "reason", "previous_entry_hash")
_ENTRY = "ledger string, seq int, decision_id string, decided_at string, decided_by string, source_document_id string, group_id string, decision string, candidate_ids array<string>, reason string, previous_entry_hash string, entry_hash string"


def _entry_hash(payload: dict) -> str:
    return hashlib.sha256(json.dumps({"schema_version": "3.0", **payload}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def append_decisions(decisions: DataFrame) -> DataFrame:
    """Entries with a hash chain for each ledger, in order of seq: a fold, since each hash holds the one before."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, before = [], None
        for r in pdf.sort_values("seq").to_dict("records"):
            payload = {k: r[k] or "" for k in LEDGER[1:7]} | {"candidate_ids": sorted(set(r["candidate_ids"] if r["candidate_ids"] is not None else [])), "reason": r["reason"] or "", "previous_entry_hash": before}
            before = _entry_hash(payload)
            rows.append({"ledger": r["ledger"], "seq": r["seq"], **payload, "entry_hash": before})
        return pd.DataFrame(rows)

    return decisions.groupBy("ledger").applyInPandas(fold, _ENTRY)


def verify_ledger(entries: DataFrame, partition: str = "ledger", order: str = "seq") -> DataFrame:
    """ledger, intact: every entry names its predecessor's hash and hashes to its own."""

    @F.pandas_udf("string")
    def again(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([_entry_hash({k: (None if r[k] is None else list(r[k]) if k == "candidate_ids" else r[k]) for k in LEDGER[1:]}) for r in frame.to_dict("records")], dtype=object)

    before = F.lag("entry_hash").over(W.partitionBy(partition).orderBy(order))
    rows = entries.withColumns({"linked": F.col("previous_entry_hash").eqNullSafe(before), "own": again(F.struct(*LEDGER[1:])) == F.col("entry_hash")})
    return rows.groupBy(partition).agg(F.every(F.col("linked") & F.col("own")).alias("intact"))


def hash_chain(rows: DataFrame, partition: str, order: str, value: Column) -> DataFrame:
    """Adds own_hash, previous_hash: each row's hash and that of the row before."""
    own = F.sha2(value, 256)
    return rows.withColumn("own_hash", own).withColumn("previous_hash", F.lag("own_hash").over(W.partitionBy(partition).orderBy(order)))


def withdrawal(records: DataFrame, document_id: str) -> DataFrame:
    """One row: a plan to withdraw a document's records; it changes nothing."""
    if not document_id.strip():
        raise ValueError("a withdrawal needs the id of a document")
    ids = records.where(F.col("source_document_id") == document_id).agg(F.array_sort(F.collect_set("record_id")).alias("affected_record_ids"))
    plan = F.concat(F.lit("withdraw-"), F.substring(F.sha2(F.to_json(F.struct(F.lit(document_id).alias("d"), "affected_record_ids")), 256), 1, 24))
    steps = F.array(*map(F.lit, ("标记该来源文档产生的记录为待撤回", "在受控写入阶段反向应用该文档的写入清单", "保留原文件、项目状态和完整决策记录")))
    return ids.select(plan.alias("plan_id"), F.lit(document_id).alias("source_document_id"), "affected_record_ids", F.lit("planned_not_executed").alias("status"), steps.alias("steps"))


def group_actions(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Groups with the reviewers' decision; hard conflicts can't be approved: ``rejected_approval``."""
    rows = groups.join(decisions.select("group_id", "decision"), "group_id", "left")
    hard = F.col("root_cause").isin("critical_fact_conflict", "project_ownership_conflict")
    result = F.when(F.col("decision").isNull(), "open").when(hard & (F.col("decision") == "accept"), "rejected_approval").otherwise(F.col("decision"))
    return rows.withColumn("result", result)


def actions_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ACTIONS.items()), "root_cause string, action string")
