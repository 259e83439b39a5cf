"""Records: normal form, validation, project transitions, legacy migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kunits.functions.text import legacy_id, unique_sorted
from kunits.schema import ACTIVE_CATEGORIES, ACTIVE_REFERENCES, ARCHIVE_OF, ARCHIVE_OUTCOMES, BUSINESS_CATEGORIES, ITEM_TYPES, LIBRARIES, PROJECT_STATES, RECORD_KINDS, SEMANTIC_KINDS, TRANSITIONS, transitions

COMMON = ("record_kind", "record_id", "title", "library", "created_at", "updated_at", "supersedes_id", "replaces_id")
LISTS = ("project_ids", "source_document_ids", "business_item_ids", "company_knowledge_ids", "derived_from_ids", "related_item_ids")
OWN = {"project": ("state", "archive_outcome", "archive_decided_at"), "source_document": ("source_path", "source_hash", "media_type"), "business_item": ("category", "item_type", "summary"), "company_knowledge": ("category", "summary", "reuse_status")}
_OWN = tuple(dict.fromkeys(f for fields in OWN.values() for f in fields))


def normalize(records: DataFrame) -> DataFrame:
    """Known fields trimmed, id lists sorted and distinct, fields of other kinds and unknown columns in extensions (JSON)."""
    have = set(records.columns)
    text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else F.lit(None).cast("string") for c in (*COMMON, *_OWN)}
    lists = {c: F.nullif(unique_sorted(F.col(c)), F.array().cast("array<string>")) if c in have else F.lit(None).cast("array<string>") for c in LISTS}
    own = {c: F.when(F.col("record_kind").isin(*(k for k, fields in OWN.items() if c in fields)), text[c]) for c in _OWN}
    extra = [c for c in records.columns if c not in (*COMMON, *LISTS, *_OWN, "schema_version", "extensions")]
    foreign = [F.when(~F.col("record_kind").isin(*(k for k, fields in OWN.items() if c in fields)), text[c]).alias(c) for c in _OWN if c in have]
    bag = F.to_json(F.struct(*foreign, *(F.col(c) for c in sorted(extra)), *([F.col("extensions")] if "extensions" in have else []))) if extra or foreign or "extensions" in have else F.lit("{}")
    return records.select(F.lit("1.0").alias("schema_version"), *(text[c].alias(c) for c in COMMON), *(own[c].alias(c) for c in _OWN), *(v.alias(k) for k, v in lists.items()), F.nullif(bag, F.lit("{}")).alias("extensions"))


def errors(strict: bool = True) -> Column:
    """All that is wrong with a normal record, as a list."""
    c, none = F.col, lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    is_kind = lambda k: c("record_kind").eqNullSafe(k)
    library = F.coalesce(c("library"), F.lit(""))
    category_ok = F.when(library == "active_tender", c("category").isin(*ACTIVE_CATEGORIES, *ACTIVE_REFERENCES)).otherwise(c("category").isin(*BUSINESS_CATEGORIES))
    rules = (
        (~F.coalesce(c("record_kind").isin(*RECORD_KINDS), F.lit(False)), "不支持的记录类型"), (none("record_id"), "record_id 不能为空"), (none("title"), "title 不能为空"),
        (~library.isin(*LIBRARIES), "library 必须是在办投标库或长期业务库"), (none("created_at"), "created_at 不能为空"), (none("updated_at"), "updated_at 不能为空"),
        (is_kind("project") & ~F.coalesce(c("state").isin(*PROJECT_STATES), F.lit(False)), "state 不是有效项目状态"),
        (is_kind("project") & c("state").eqNullSafe("archived") & ~F.coalesce(c("archive_outcome").isin(*ARCHIVE_OUTCOMES), F.lit(False)), "归档项目必须说明 archive_outcome"),
        (is_kind("project") & ~c("state").eqNullSafe("archived") & ~none("archive_outcome"), "未归档项目不能设置 archive_outcome"),
        (is_kind("source_document") & none("source_path") & none("source_hash"), "来源文档至少需要 source_path 或 source_hash"),
        (is_kind("business_item") & ~none("category") & ~F.coalesce(category_ok, F.lit(False)), "category 不是所属库的有效目录分类"),
        (is_kind("business_item") & ~none("item_type") & ~F.coalesce(c("item_type").isin(*ITEM_TYPES, *SEMANTIC_KINDS), F.lit(False)), "item_type 不是有效业务条目类型"),
        (is_kind("company_knowledge") & (library != "business"), "公司知识只能存放在长期业务库"),
    )
    return F.array_compact(F.array(*(F.when(bad, F.lit(said)) for bad, said in rules)))


def migrate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records in normal form, the others with their errors). Idempotent."""
    rows = normalize(records).withColumn("errors", errors())
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def transition_reason(state: Column, to: Column, outcome: Column, explicit: Column) -> Column:
    """Why a project may not change state; null if it may."""
    legal = F.lit(False)
    for a, b in TRANSITIONS.items():
        legal = legal | ((state == a) & to.isin(*b)) if b else legal
    wanted = F.create_map(*(F.lit(x) for pair in ARCHIVE_OF.items() for x in pair))[state]
    unknown = ~F.coalesce(state.isin(*PROJECT_STATES) & to.isin(*PROJECT_STATES), F.lit(False))
    return F.when(unknown, "项目状态无效").when(~legal, "不允许的状态转换").when((to == "archived") & ~wanted.eqNullSafe(outcome), "归档结果与当前项目状态不匹配").when((to == "archived") & (state == "paused") & ~explicit.eqNullSafe(True), "暂停项目只能在明确作出归档决定后归档")


def with_transition(rows: DataFrame, state: str = "from_state", to: str = "to_state") -> DataFrame:
    """Adds allowed: whether the pair is in the fixed transition table (a broadcast join)."""
    legal = F.broadcast(transitions(rows.sparkSession).withColumn("allowed", F.lit(True)))  # a few dozen rows
    return rows.join(legal, (rows[state] == legal["from_state"]) & (rows[to] == legal["to_state"]), "left").select(rows["*"], F.coalesce("allowed", F.lit(False)).alias("allowed"))


def legacy_plan(cards: DataFrame, tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """Dry-run actions for old cards (card_id, title, project, nth), tasks (task_id, source_path, nth) and projects."""
    none = F.lit(None).cast("string")
    a = cards.select(F.lit("extract_reusable_knowledge").alias("action"), legacy_id("legacy-card", F.coalesce("card_id", "title"), F.col("nth")).alias("source_ref"), F.lit("company_knowledge").alias("target_kind"), F.lit(True).alias("ready"), none.alias("reason"))
    b = tasks.select(F.lit("register_source_once").alias("action"), legacy_id("legacy-task", F.coalesce("task_id", "source_path"), F.col("nth")).alias("source_ref"), F.lit("source_document").alias("target_kind"), F.lit(True).alias("ready"), none.alias("reason"))
    why = transition_reason(F.col("state"), F.lit("archived"), F.col("archive_outcome"), F.col("explicit_archival_decision"))
    c = projects.select(F.lit("archive_complete_project").alias("action"), legacy_id("legacy-project", F.coalesce("record_id", "title"), F.col("nth")).alias("source_ref"), F.lit("project").alias("target_kind"), why.isNull().alias("ready"), why.alias("reason"))
    return a.unionByName(b).unionByName(c)


def merge_unknown(old: Column, new: Column) -> Column:
    """JSON objects merged: fields of *new* win, unknown ones of *old* stay."""
    as_map = lambda c: F.from_json(c, "map<string,string>")
    a, b = F.coalesce(as_map(old), F.create_map().cast("map<string,string>")), F.coalesce(as_map(new), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def migrate_review(artifacts: DataFrame) -> DataFrame:
    """Review artifacts 1.3 as 2.0: all fields stay, version and schema change; 2.0 stays as it is."""
    version = F.get_json_object("artifact", "$.schema_version")
    stamp = F.lit('{"schema_version":"2.0","migrated_from":"1.3"}')
    return artifacts.withColumn("artifact", F.when(version == "1.3", merge_unknown(F.col("artifact"), stamp)).otherwise(F.col("artifact")))


def schema_errors(value: Column, required: dict[str, str]) -> Column:
    """Violations of a flat JSON schema: missing fields and fields of another type (string, number, boolean)."""
    doc = F.try_parse_json(value)
    out = [F.when(doc.isNull(), F.lit("not_json"))]
    for field, kind in required.items():
        found = F.get_json_object(value, f"$.{field}")
        shape = F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))
        ok = shape.isin(*{"string": ("STRING",), "number": ("BIGINT", "DOUBLE"), "boolean": ("BOOLEAN",)}[kind]) | ((F.lit(kind) == "number") & shape.startswith("DECIMAL"))
        out.append(F.when(doc.isNotNull() & found.isNull(), F.lit(f"{field}:missing")).when(doc.isNotNull() & ~ok, F.lit(f"{field}:type")))
    return F.array_compact(F.array(*out))
