"""Candidates: project matching, routing, validation, consolidation, batches, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.functions.text import clean_text, identity_key, stable_id, unique_first, verbatim
from kunits.operators.blocks import strict_locator
from kunits.schema import BATCH_LIMITS, DOCUMENT_ROLES, ITEM_TYPES, LIBRARIES, categories

FACT_KEYS = ("actors", "status", "dates", "units", "numbers", "modality")
#: Reasons for review and what they read as (fixed values).
REASON_LABELS = {
    "ambiguous_project": "项目证据有歧义", "ambiguous_category": "目录判断有歧义", "conflicting_facts": "数字、日期、单位、语气或适用条件存在冲突",
    "missing_evidence": "缺少可核对的原文证据", "unsupported_invented_facts": "候选包含来源不支持的补充事实", "reuse_promotion": "标记为可复用知识仍需人工批准",
}


def registry_identities(registry: DataFrame) -> DataFrame:
    """project_id, identity: normalised name, aliases and references of each registered project."""
    none = F.array().cast("array<string>")
    names = F.concat(F.array("name"), F.coalesce("aliases", none), F.coalesce("references", none))
    rows = registry.select(clean_text(F.col("project_id"), 200).alias("project_id"), F.explode(names).alias("name")).where("project_id <> ''")
    return rows.select("project_id", identity_key(F.col("name")).alias("identity")).where("identity <> ''").distinct()


def project_evidence(documents: DataFrame, blocks: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """id, value, source, identity: explicit signs of a project in metadata and file names.

    *documents*: id, filename, metadata (map); *blocks*: id, block_id, metadata.
    """
    keys = ("project_id", "project_name", "project_reference")
    stem = F.regexp_replace(clean_text(F.col("filename"), 500), r"\.[^.]+$", "")
    of_doc = F.array(*(F.struct(F.col("metadata")[k].alias("value"), F.lit(f"document.metadata.{k}").alias("source")) for k in keys), F.struct(stem.alias("value"), F.lit("filename").alias("source")))
    tokens = F.transform(F.filter(F.split(stem, r"[\s\-_.:/\\()\[\]{}]+"), lambda t: t != ""), lambda t: F.struct(t.alias("value"), F.lit("filename_token").alias("source")))
    of_block = F.array(*(F.struct(F.col("metadata")[k].alias("value"), F.concat("block_id", F.lit(f".metadata.{k}")).alias("source")) for k in keys))
    rows = documents.select(id_col, F.inline(F.concat(of_doc, tokens))).unionByName(blocks.select(id_col, F.inline(of_block)))
    return rows.where("value is not null").withColumn("identity", identity_key(F.col("value"))).where("identity <> ''")


def match_projects(evidence: DataFrame, identities: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """id, matches, project_id, outcome (matched, ambiguous): by equality of normalised identities."""
    hits = evidence.select(id_col, "identity").distinct().join(identities, "identity").groupBy(id_col).agg(F.array_sort(F.collect_set("project_id")).alias("projects"))
    one = F.size("projects") == 1
    return hits.select(id_col, F.size("projects").alias("matches"), F.when(one, F.col("projects")[0]).alias("project_id"), F.when(one, "matched").otherwise("ambiguous").alias("outcome"))


def with_valid_category(rows: DataFrame, library: str = "library", category: str = "directory_category") -> DataFrame:
    """Rows whose category is one of their library's: a left semi join with a fixed table."""
    known = F.broadcast(categories(rows.sparkSession))  # 43 rows
    return rows.join(known, (rows[library] == known["library"]) & (rows[category] == known["category"]), "left_semi")


def local_route(documents: DataFrame, matched: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """Route from explicit metadata: library, category, role, project, review reasons, resolved."""
    m = lambda *names: F.coalesce(*(F.nullif(clean_text(F.col("metadata")[n], 300), F.lit("")) for n in names))
    rows = documents.join(matched.select(id_col, "project_id", F.col("outcome").alias("match")), id_col, "left")
    rows = rows.withColumns({"library": F.when(m("library").isin(*LIBRARIES), m("library")), "asked": m("directory_category", "category"), "role": m("document_role")})
    known = F.broadcast(categories(rows.sparkSession).withColumn("directory_category", F.col("category")))  # 43 rows
    rows = rows.join(known.withColumnsRenamed({"library": "_lib", "category": "_cat"}), (F.col("library") == F.col("_lib")) & (F.col("asked") == F.col("_cat")), "left")
    role = F.when(F.col("role").isin(*DOCUMENT_ROLES) & (F.col("role") != "unknown"), F.col("role"))
    reasons = F.array_compact(F.array(F.when(F.col("match") == "ambiguous", "ambiguous_project"), F.when(F.col("asked").isNotNull() & F.col("directory_category").isNull(), "ambiguous_category")))
    sure = F.when(F.col("match").eqNullSafe("matched") | F.col("library").isNotNull(), 1.0).otherwise(0.0)
    resolved = F.col("library").isNotNull() & F.col("directory_category").isNotNull() & role.isNotNull() & (F.size(reasons) == 0)
    return rows.select(id_col, "project_id", "library", "directory_category", role.alias("document_role"), *(m(k).alias(k) for k in ("supersedes_document_id", "replaces_document_id", "version_label")), sure.alias("confidence"), reasons.alias("review_reasons"), resolved.alias("resolved"))


def merge_route(local: DataFrame, proposed: DataFrame, evidenced: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """The local route filled in by a provider's; it may not bring in a project without evidence.

    *proposed*: id, project_id, library, directory_category, document_role;
    *evidenced*: id, project_id pairs that explicit evidence supports.
    """
    p = proposed.select(id_col, *(F.col(c).alias(f"p_{c}") for c in ("project_id", "library", "directory_category", "document_role")))
    rows = local.join(p, id_col, "left").withColumns({c: F.coalesce(F.col(f"p_{c}"), F.col(c)) for c in ("project_id", "library", "directory_category", "document_role")})
    ok = evidenced.select(id_col, "project_id").distinct().withColumn("held", F.lit(True))
    rows = rows.join(ok, [id_col, "project_id"], "left")
    invented = F.col("project_id").isNotNull() & F.col("held").isNull()
    library = F.when(F.col("library").isin(*LIBRARIES), F.col("library"))
    known = F.broadcast(categories(rows.sparkSession)).withColumnsRenamed({"library": "_lib", "category": "_cat"})
    rows = rows.withColumn("library", library).join(known, (F.col("library") == F.col("_lib")) & (F.col("directory_category") == F.col("_cat")), "left")
    wrong = F.col("directory_category").isNotNull() & F.col("_cat").isNull()
    role = F.when(F.col("document_role").isin(*DOCUMENT_ROLES), F.col("document_role")).otherwise("unknown")
    reasons = F.array_distinct(F.concat("review_reasons", F.array_compact(F.array(F.when(invented, "unsupported_invented_facts"), F.when(wrong, "ambiguous_category")))))
    resolved = F.col("library").isNotNull() & F.col("_cat").isNotNull() & (role != "unknown") & (F.size(reasons) == 0)
    return rows.select(id_col, F.when(~invented, F.col("project_id")).alias("project_id"), "library", F.col("_cat").alias("directory_category"), role.alias("document_role"), "confidence", reasons.alias("review_reasons"), resolved.alias("resolved"))


def batches(blocks: DataFrame, id_col: str = "source_document_id", size: int = BATCH_LIMITS["blocks"], resume: int = 0, most: int = BATCH_LIMITS["requests"]) -> DataFrame:
    """Blocks with batch numbers from *resume*, at most *most* batches a run: the request limit is the feature."""
    nth = F.row_number().over(W.partitionBy(id_col).orderBy("ord"))
    return blocks.withColumn("batch", F.floor((nth - 1) / size).cast("int")).where(F.col("batch").between(resume, resume + most - 1))


def routing_input(blocks: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """What a routing provider sees: the first 30 blocks of a document, bounded fields."""
    first = blocks.withColumn("nth", F.row_number().over(W.partitionBy(id_col).orderBy("ord"))).where("nth <= 30")
    return first.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("nth", F.substring("block_id", 1, 100).alias("block_id"), F.substring("kind", 1, 100).alias("kind")))).alias("blocks"))


def extraction_input(batched: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """What an extraction provider sees: the blocks of a batch with bounded text."""
    part = F.struct("ord", F.substring("block_id", 1, 100).alias("block_id"), "kind", clean_text(F.col("text"), BATCH_LIMITS["block_text"]).alias("text"))
    return batched.groupBy(id_col, "batch").agg(F.array_sort(F.collect_list(part)).alias("blocks"))


def normalized_facts(facts: Column) -> Column:
    """struct of the six lists of facts, each distinct and of at most 20; null where nothing is left."""
    lists = {k: F.nullif(unique_first(F.transform(facts[k], lambda v: clean_text(v, 300)), 20), F.array().cast("array<string>")) for k in FACT_KEYS}
    return F.when(F.coalesce(*lists.values()).isNotNull(), F.struct(*(v.alias(k) for k, v in lists.items())))


def evidence_within(quote: Column, text: Column) -> Column:
    quote = verbatim(quote, BATCH_LIMITS["evidence_text"])
    return (quote != "") & F.contains(verbatim(text, BATCH_LIMITS["block_text"]), quote)


def validate(raw: DataFrame, blocks: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """Raw candidates joined to their blocks, with error (null if valid) and candidate_id.

    *raw*: id, item_type, block_id, verbatim, summary, applicable_conditions,
    facts, reusable, project_id, directory_category. The first failing rule is
    the error: type, block, locator, evidence.
    """
    b = blocks.select(id_col, "block_id", F.col("text").alias("block_text"), F.col("locator").alias("block_locator"))
    rows = raw.join(b, [id_col, "block_id"], "left")
    where = strict_locator(F.col("block_locator"))
    error = (
        F.when(~F.coalesce(F.col("item_type").isin(*ITEM_TYPES), F.lit(False)), "业务条目类型不在定义中").when(F.col("block_text").isNull(), "证据块不在当前批次")
        .when(where.isNull(), "证据块缺少有效定位").when(~evidence_within(F.col("verbatim"), F.col("block_text")), "逐字证据不在指定块中")
    )
    quote = verbatim(F.col("verbatim"), BATCH_LIMITS["evidence_text"])
    conditions = unique_first(F.transform(F.coalesce("applicable_conditions", F.array().cast("array<string>")), lambda c: clean_text(c, 500)), 20)
    key = F.concat_ws(":", where["scheme"], where["value"])
    made = stable_id("bic", F.col(id_col).cast("string"), F.col("block_id"), key, F.col("item_type"), identity_key(quote), F.to_json(conditions))
    return rows.select(
        "*", error.alias("error"), F.when(error.isNull(), made).alias("candidate_id"), key.alias("locator_key"), quote.alias("quote"), conditions.alias("conditions"),
        F.coalesce(F.nullif(clean_text(F.col("summary"), 1000), F.lit("")), quote).alias("said"), F.array_compact(F.array(F.when(F.col("reusable").eqNullSafe(True), "reuse_promotion"))).alias("review_reasons"),
    )


def conflict_signature(facts: Column, conditions: Column, item_type: Column) -> Column:
    """Text that differs where numbers, dates, units, modality, conditions or type do."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(facts[k], none).alias(k) for k in ("numbers", "dates", "units", "modality")]
    return F.to_json(F.struct(*parts, F.coalesce(conditions, none).alias("conditions"), item_type.alias("item_type")))


def boundary_key(metadata: Column, locator_key: Column, block_id: Column) -> Column:
    """Key of what counts as one item: explicit id, else table row with locator, else mail, else block."""
    m = lambda *names: F.coalesce(*(F.nullif(F.trim(metadata[n]), F.lit("")) for n in names))
    return F.coalesce(F.concat(F.lit("item:"), m("same_item_id")), F.concat(F.lit("row:"), m("table_row_id", "row_id"), F.lit("|"), locator_key), F.concat(F.lit("mail:"), m("email_message_id", "message_id")), F.concat(F.lit("block:"), block_id))


def consolidate(candidates: DataFrame, id_col: str = "source_document_id", boundary: str = "boundary", order: str = "ord") -> DataFrame:
    """Candidates of one document, type, boundary, content and signature as one; conflicts flagged.

    Needs columns: quote, said, item_type, facts, conditions, review_reasons,
    reuse_reasons. Of equal candidates the first stays with all reasons. Those
    of one summary but different signatures get ``conflicting_facts``.
    """
    rows = candidates.withColumns({"signature": conflict_signature(F.col("facts"), F.col("conditions"), F.col("item_type")), "content": identity_key(F.coalesce(F.nullif("quote", F.lit("")), F.col("said")))})
    keys = [id_col, "item_type", boundary, "content", "signature"]
    kept = [c for c in rows.columns if c not in (*keys, "review_reasons", "reuse_reasons")]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("review_reasons")))).alias("review_reasons"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reuse_reasons")))).alias("reuse_reasons"))
    one = one.select(*keys, "c.*", "review_reasons", "reuse_reasons").withColumn("summary_key", identity_key(F.col("said")))
    groups = one.groupBy(id_col, "item_type", "summary_key").agg(F.count_distinct("signature").alias("signatures"))
    one = one.join(groups, [id_col, "item_type", "summary_key"])
    reasons = F.when(F.col("signatures") > 1, F.array_union("review_reasons", F.array(F.lit("conflicting_facts")))).otherwise(F.col("review_reasons"))
    return one.withColumn("review_reasons", reasons).drop("summary_key", "content", "signatures")


def review_summary(routes: DataFrame, candidates: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """id, summary: a text for reviewers with the first eight candidates and the reasons."""
    place = F.coalesce(F.concat_ws(" ", F.col("locator.scheme"), F.col("locator.value")), F.concat(F.lit("块 "), F.col("block_id")))
    line = F.concat(F.lit("- "), F.col("said"), F.lit("（来源："), place, F.lit("）"))
    rows = candidates.groupBy(id_col).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"), F.array_distinct(F.flatten(F.collect_list("review_reasons"))).alias("reasons"))
    rows = routes.join(rows, id_col, "left")
    labels = F.create_map(*(F.lit(x) for pair in REASON_LABELS.items() for x in pair))
    none = F.array().cast("array<string>")
    reasons = F.array_distinct(F.concat("review_reasons", F.coalesce("reasons", none)))
    named = F.filter(F.transform(reasons, lambda r: labels[r]), lambda r: r.isNotNull())
    parts = [
        F.concat(F.lit("发现 "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" 条可审阅业务候选。")),
        F.coalesce(F.concat(F.lit("文档关联到登记项目“"), F.col("project_id"), F.lit("”。")), F.lit("项目关联尚未确定。")),
        F.coalesce(F.concat(F.lit("建议目录为 "), F.col("library"), F.lit(" / "), F.col("directory_category"), F.lit("。")), F.lit("建议目录尚未确定。")),
        F.nullif(F.array_join(F.slice(F.transform(F.coalesce("lines", F.array().cast("array<struct<ord:int,line:string>>")), lambda x: x["line"]), 1, 8), "\n"), F.lit("")),
        F.when(F.size(reasons) > 0, F.concat(F.lit("需要复核："), F.array_join(named, "；"), F.lit("。"))).otherwise("当前候选没有触发人工复核条件。"),
        F.lit("可选操作：确认候选；修改项目或目录；退回并保留来源不入库。"),
    ]
    return rows.select(id_col, F.concat_ws("\n", *parts).alias("summary"))
