"""Write plans: identities, record builders, relations, diffs, conflicts, archive moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.functions.text import clean_writer, front_value, json_text, path_safe, safe_segment, unique_sorted
from kunits.schema import KIND_FOLDER, KIND_PREFIX, LIBRARIES, PLAN_LIMITS, relation_rules

ACTIVE_ROOT, BUSINESS_ROOT, STATE_ROOT = "06-知识库/招投标库", "06-知识库/业务库", "06-知识库/源文件/_slicer_artifacts"


def settings(given: dict | None = None) -> dict:
    """Roots and limits, clamped; the writer is off unless it is switched on."""
    given = given or {}
    clamp = lambda key, usual, most: max(1, min(most, int(given.get(key) or usual)))
    return {
        "enabled": given.get("enabled") is True, "mode": given.get("mode", "legacy") if given.get("enabled") is True else "legacy",
        "active_root": given.get("active_root") or ACTIVE_ROOT, "business_root": given.get("business_root") or BUSINESS_ROOT, "state_root": given.get("state_root") or STATE_ROOT,
        "max_records": clamp("max_records", 100, PLAN_LIMITS["records"]), "max_actions": clamp("max_actions", 300, PLAN_LIMITS["actions"]), "max_links": clamp("max_links", 20, PLAN_LIMITS["links"]),
    }


def check_roots(active: str, business: str, protected: list[str]) -> None:
    """Refuse roots that are equal, nested or in a protected folder."""
    inside = lambda a, b: a == b or a.startswith(b + "/") or b.startswith(a + "/")
    if inside(active, business):
        raise ValueError("两库根目录不能相同或互相嵌套")
    if any(inside(root, p) for root in (active, business) for p in protected if p):
        raise ValueError("结构化输出根目录不得与来源或插件状态目录重叠")


def source_identity(source_identity: Column, ingestion_id: Column, provider_id: Column, source_hash: Column) -> Column:
    """Stable identity of a source: explicit, ingestion, provider, first hash; an error without any."""
    step = lambda name, c, most: F.when(clean_writer(c, most) != "", F.concat(F.lit(f"{name}:"), clean_writer(c, most)))
    return F.coalesce(step("explicit", source_identity, 300), step("ingestion", ingestion_id, 300), step("provider", provider_id, 500), step("initial-hash", source_hash, 128), F.raise_error(F.lit("来源缺少稳定身份；不能用可变标题或路径生成 ID")))


def record_id(kind: str, identity: Column) -> Column:
    return F.concat(F.lit(KIND_PREFIX[kind] + "-"), F.substring(F.sha2(identity, 256), 1, 24))


def candidate_identity(source_id: Column, candidate_id: Column, block_id: Column, locator: Column, quote: Column) -> Column:
    explicit = clean_writer(candidate_id, 300)
    by_place = F.concat(source_id, F.lit(":evidence:"), clean_writer(block_id, 200), F.lit(":"), F.to_json(locator), F.lit(":"), F.sha2(clean_writer(quote, 4000), 256))
    return F.when(explicit != "", F.concat(source_id, F.lit(":candidate:"), explicit)).otherwise(by_place)


def approved_items(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with a decision that isn't mandatory handling."""
    return candidates.join(decisions.where(F.col("outcome") != "mandatory_human_handling").select("candidate_id"), "candidate_id", "left_semi")


def promotions(candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """Reusable candidates whose promotion is approved."""
    return candidates.where(F.col("reusable").eqNullSafe(True)).join(approved, "candidate_id", "left_semi")


def not_in_review(units: DataFrame, reviews: DataFrame) -> DataFrame:
    """Units that no review group holds."""
    return units.join(reviews.select(F.explode("unit_ids").alias("unit_id")), "unit_id", "left_anti")


def registry_unique(units: DataFrame, registry: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """id, projects, ok: units of the active library must match exactly one registered project."""
    used = units.select(id_col, (F.col("route.library") == "active_tender").alias("active"), F.explode_outer("project_ids").alias("project_id"))
    hit = used.join(registry.select("project_id", F.lit(True).alias("known")).distinct(), "project_id", "left")
    per = hit.groupBy(id_col).agg(F.max("active").alias("active"), F.count_distinct(F.when(F.col("known"), F.col("project_id"))).alias("projects"))
    return per.withColumn("ok", ~F.col("active") | (F.col("projects") == 1))


def unit_records(units: DataFrame, source_ids: DataFrame, now: str, id_col: str = "source_document_id") -> DataFrame:
    """Records of units: reusable ones of the business library are company knowledge, others business items."""
    rows = units.join(source_ids.select(id_col, "source_id"), id_col)
    company = (F.col("route.library") == "business") & F.col("reusable")
    key = F.concat("source_id", F.lit(":unit:"), "fingerprint")
    return rows.select(
        id_col, "unit_id", F.when(company, "company_knowledge").otherwise("business_item").alias("record_kind"), F.when(company, record_id("company_knowledge", key)).otherwise(record_id("business_item", key)).alias("record_id"),
        F.substring("title", 1, 160).alias("title"), F.col("route.library").alias("library"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.col("route.category").alias("category"),
        F.when(~company, F.col("semantic_kind")).alias("item_type"), F.when(company, "auto_supported").alias("reuse_status"), F.substring("statement", 1, 8000).alias("summary"), "tags", F.col("evidence")[0].alias("evidence"),
        "semantic_kind", "source_language", F.array("source_id").alias("source_document_ids"), F.col("source_id").alias("owner_source_id"),
    )


def two_way(edges: DataFrame) -> DataFrame:
    """Relations in both directions, once each."""
    back = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type")
    return edges.select("from_id", "to_id", "type").unionByName(back).distinct()


def route_path(kind: Column, key: Column, library: Column, category: Column, project: Column, active_root: str = ACTIVE_ROOT, business_root: str = BUSINESS_ROOT) -> Column:
    """Where a record goes; an error without a category, or without a project in the active library."""
    folder = F.create_map(*(F.lit(x) for pair in KIND_FOLDER.items() for x in pair))[kind]
    category = F.when(F.coalesce(category, F.lit("")) == "", F.raise_error(F.lit("结构化路由分类未确定，禁止使用默认目录"))).otherwise(safe_segment(category))
    project = F.when(F.coalesce(project, F.lit("")) == "", F.raise_error(F.lit("在办库记录缺少唯一项目登记"))).otherwise(safe_segment(project))
    file = F.concat(key, F.lit(".md"))
    return F.when(library == "active_tender", F.concat_ws("/", F.lit(active_root), project, category, folder, file)).otherwise(F.concat_ws("/", F.lit(business_root), category, folder, file))


def valid_index(index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good entries, conflicts of paths with several ids, discarded entries)."""
    good = path_safe(F.col("path")) & (F.col("record_id") != "") & F.col("record_id").eqNullSafe(F.col("key"))
    rows = index.withColumn("good", F.coalesce(good, F.lit(False)))
    kept = rows.where("good").drop("good")
    conflicts = kept.groupBy("path").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids")).where(F.size("record_ids") > 1)
    return kept, conflicts.select(F.lit("path_indexed_by_multiple_ids").alias("cause"), "path", "record_ids"), rows.where("not good").select(F.lit("malformed_index").alias("cause"), "key")


def physical_duplicates(files: DataFrame) -> DataFrame:
    """record_id, paths: an id that files at several paths carry. *files*: path, content."""
    rows = files.select("path", front_value(F.col("content"), "record_id").alias("record_id")).where("record_id <> ''")
    return rows.groupBy("record_id").agg(F.array_sort(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1).withColumn("cause", F.lit("same_id_multiple_paths"))


def resolve_relations(requested: DataFrame, targets: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(resolved relations, unresolved ones with reason).

    *requested*: from_id, from_kind, source_document_id, nth, type, target_ids;
    *targets*: record_id, record_kind, title, path. Exactly one target of a
    kind that the type allows resolves; at most *most* links a record, in order.
    """
    rules = F.broadcast(relation_rules(requested.sparkSession))  # a fixed table
    rows = requested.withColumn("target_id", F.explode_outer(unique_sorted(F.col("target_ids"))))
    rows = rows.join(targets.select(F.col("record_id").alias("target_id"), F.col("record_kind").alias("to_kind"), F.col("title").alias("target_title"), F.col("path").alias("target_path")), "target_id", "left")
    fits = rules.withColumn("fits", F.lit(True))
    rows = rows.join(fits, (rows["type"] == fits["type"]) & (rows["from_kind"] == fits["from_kind"]) & (rows["to_kind"] == fits["to_kind"]), "left").select(rows["*"], "fits")
    one = F.collect_list(F.when(F.col("fits"), F.struct("target_id", "target_title", "target_path")))
    per = rows.groupBy("from_id", "from_kind", "source_document_id", "nth", "type").agg(F.count("target_id").alias("asked"), one.alias("ok"))
    known = rules.select("type").distinct().withColumn("known", F.lit(True))
    per = per.join(F.broadcast(known), "type", "left")
    n = F.size("ok")
    reason = F.when(F.col("known").isNull(), "unsupported_relation_type").when(F.col("asked") == 0, "unresolved_target").when(n > 1, "ambiguous_target").when(n == 0, "type_mismatch_or_missing")
    per = per.withColumn("reason", reason)
    good = per.where("reason is null").select("from_id", "type", "nth", "ok").withColumn("t", F.col("ok")[0])
    good = good.groupBy("from_id", "type", "t.target_id").agg(F.min("nth").alias("nth"), F.first("t.target_title").alias("target_title"), F.first("t.target_path").alias("target_path")).where("target_path is not null")
    good = good.withColumn("rank", F.row_number().over(W.partitionBy("from_id").orderBy("nth", "type", "target_id"))).where(F.col("rank") <= most).drop("rank", "nth")
    return good, per.where("reason is not null").select("source_document_id", "from_id", "type", "nth", "reason")


def unresolved_groups(unresolved: DataFrame) -> DataFrame:
    """source_document_id, cause, issues, sorted by both."""
    issue = F.struct("from_id", "nth", "type")
    return unresolved.groupBy("source_document_id", F.col("reason").alias("cause")).agg(F.array_sort(F.collect_list(issue)).alias("issues")).orderBy("source_document_id", "cause")


def relation_link(target_id: Column, title: Column) -> Column:
    return F.concat(F.lit("[["), target_id, F.lit("|"), F.coalesce(F.nullif(title, F.lit("")), target_id), F.lit("]]"))


def human_locator(locator: Column) -> Column:
    """A place in words."""
    part = lambda c, before, after="": F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(before), c.cast("string"), F.lit(after)))
    bare = locator["page"].isNull() & locator["sheet"].isNull() & locator["range"].isNull()
    parts = F.concat_ws("，", part(locator["page"], "第 ", " 页"), part(locator["sheet"], "工作表“", "”"), part(locator["range"], "区域 "), part(locator["row"], "第 ", " 行"), part(locator["message_id"], "邮件 "), part(F.array_join(locator["heading_path"], " / "), "章节 "), F.when(bare, locator["value"]))
    return F.when(parts == "", "来源原文").otherwise(parts)


_FRONT = ("state", "archive_outcome", "source_path", "source_hash", "source_version", "media_type", "category", "item_type", "reuse_status", "semantic_kind", "source_language")


def serialize(records: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Adds content and content_hash: deterministic Markdown with front matter."""
    have = records.columns
    rows = records
    if relations is not None:
        line = F.concat(F.lit("- "), "type", F.lit("："), relation_link(F.col("target_id"), F.col("target_title")))
        links = relations.groupBy(F.col("from_id").alias("record_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("type", "target_id", line.alias("line")))), lambda x: x["line"]).alias("_links"))
        rows = rows.join(links, "record_id", "left")
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    scalar = lambda c, v=None: F.concat(F.lit(f"{c}: "), json_text(F.coalesce(v if v is not None else text(c), F.lit(""))))
    if_any = lambda c: F.when(F.coalesce(text(c), F.lit("")) != "", scalar(c))
    array = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{c}: ["), F.array_join(F.transform(unique_sorted(F.col(c)), lambda v: F.substring(F.to_json(F.array(v)), F.lit(2), F.length(F.to_json(F.array(v))) - 2)), ", "), F.lit("]"))) if c in have else F.lit(None).cast("string")
    front = [F.lit("---"), scalar("schema_version", F.lit("1.0")), *(scalar(c) for c in ("record_kind", "record_id", "title")), F.concat(F.lit("aliases: ["), json_text(F.col("title")), F.lit("]")), *(scalar(c) for c in ("library", "created_at", "updated_at")), *(if_any(c) for c in _FRONT), scalar("output_language", F.lit("zh-CN")), array("tags"), *(array(c) for c in ("project_ids", "source_document_ids", "business_item_ids", "company_knowledge_ids")), F.lit("---"), F.lit("")]
    body = [F.concat(F.lit("# "), F.col("title")), F.lit(""), F.when(F.coalesce(text("summary"), F.lit("")) != "", F.concat(F.lit("## 内容\n\n"), text("summary"), F.lit("\n")))]
    if "evidence" in have:
        quote = F.concat(F.lit("## 来源证据（原文）\n\n> "), F.regexp_replace(F.substring(F.col("evidence.verbatim"), 1, 4000), "\n", "\n> "), F.lit("\n\n定位："), human_locator(F.col("evidence.locator")), F.lit("\n"))
        body.append(F.when(F.coalesce(F.col("evidence.verbatim"), F.lit("")) != "", quote))
    if relations is not None:
        body.append(F.when(F.col("_links").isNotNull(), F.concat(F.lit("## 关系\n\n"), F.array_join("_links", "\n"), F.lit("\n"))))
    end = [F.lit("## 追溯\n"), F.concat(F.lit("- 记录编号："), F.col("record_id")), F.concat(F.lit("- 归属来源："), text("owner_source_id")), F.concat(F.lit("- 来源哈希："), F.nullif(text("source_hash"), F.lit("")))]
    rows = rows.withColumn("content", F.concat(F.concat_ws("\n", *front, *body, *end), F.lit("\n"))).withColumn("content_hash", F.sha2("content", 256))
    return rows.drop("_links") if relations is not None else rows


def diff(records: DataFrame, index: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, conflicts): records against the index and the files that are there.

    *records*: record_id, record_kind, path, content, content_hash; *index*:
    record_id, path, content_hash; *files*: path, content. A known id keeps its
    path. Actions are create, update or noop, by record id.
    """
    known = index.select("record_id", F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash"))
    rows = records.join(known, "record_id", "left").withColumn("path", F.coalesce("old_path", "path"))
    there = files.select("path", F.col("content").alias("prior"))
    rows = rows.join(there, "path", "left")
    occupant = front_value(F.col("prior"), "record_id")
    rows = rows.withColumns({"occupied_id": F.nullif(occupant, F.lit("")), "prior_hash": F.when(F.col("prior").isNotNull(), F.sha2("prior", 256))})
    cause = F.when(F.col("occupied_id").isNotNull() & (F.col("occupied_id") != F.col("record_id")), "path_occupied_by_different_id").when(F.col("prior_hash").isNotNull() & F.col("old_hash").isNotNull() & (F.col("prior_hash") != F.col("old_hash")), "optimistic_hash_mismatch")
    rows = rows.withColumn("cause", cause)
    action = F.when(F.col("prior_hash").isNull(), "create").when(F.col("prior_hash") == F.col("content_hash"), "noop").otherwise("update")
    actions = rows.where("cause is null").withColumn("action", action).drop("cause", "prior", "old_path", "old_hash", "occupied_id")
    return actions, rows.where("cause is not null").select("cause", "record_id", "path", "occupied_id")


def archive(actions: DataFrame, active_root: str = ACTIVE_ROOT, business_root: str = BUSINESS_ROOT) -> DataFrame:
    """Actions with those of the active library moved to the historical projects."""
    inside = F.col("path").startswith(active_root + "/")
    to = F.concat(F.lit(f"{business_root}/complete_historical_projects/"), F.substring("path", len(active_root) + 2, 2000))
    moved = F.when(F.col("prior_hash").isNull(), "create").when(F.col("action") == "noop", "move").otherwise(F.concat("action", F.lit("_and_move")))
    return actions.withColumns({"from_path": F.when(inside & F.col("prior_hash").isNotNull(), F.col("path")), "action": F.when(inside, moved).otherwise(F.col("action")), "path": F.when(inside, to).otherwise(F.col("path"))})


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def plan(records: DataFrame, index: DataFrame, files: DataFrame, review_groups: int = 0, handling_groups: int = 0, limits: dict | None = None) -> dict:
    """A plan: actions (DataFrame), conflicts (DataFrame), counts, blocked.

    It is blocked by any conflict, review or handling group; more records or
    actions than the limits are an error. Only counts come to the driver.
    """
    limits = limits or settings()
    if records.limit(limits["max_records"] + 1).count() > limits["max_records"]:
        raise ValueError("结构化记录数量超过安全上限")
    kept, path_conflicts, _ = valid_index(index)
    actions, conflicts = diff(records, kept, files)
    every = conflicts.select("cause", "record_id", "path").unionByName(path_conflicts.select("cause", F.col("record_ids")[0].alias("record_id"), "path")).unionByName(physical_duplicates(files).select("cause", "record_id", F.col("paths")[0].alias("path")))
    counts = {r.action: r.n for r in action_counts(actions).collect()}  # five kinds at most
    if sum(counts.values()) > limits["max_actions"]:
        raise ValueError("写入计划超过安全上限")
    clashes = every.count()
    said = f"新建 {counts.get('create', 0)}，更新 {counts.get('update', 0)}，不变 {counts.get('noop', 0)}，移动 {counts.get('move', 0)}，需要处理 {clashes + review_groups + handling_groups}。"
    return {"actions": actions, "conflicts": every, "counts": counts, "blocked": bool(clashes or review_groups or handling_groups), "summary": said}


def library_valid(column: Column) -> Column:
    return column.isin(*LIBRARIES)
