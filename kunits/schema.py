"""Taxonomies and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Kinds of blocks (fixed values).
BLOCK_KINDS = ("heading", "paragraph", "list", "list_item", "table", "table_row", "key_value", "figure", "caption", "header", "footer", "email_envelope", "email_body", "email_thread", "sheet", "page", "attachment", "text")
LAYOUT_KINDS = ("figure", "attachment", "page", "sheet")
SEMANTIC_KINDS = ("fact", "requirement", "decision", "action", "process", "method", "parameter", "risk", "issue", "experience", "commercial_term", "schedule", "entity_profile", "correspondence")
REGION_KINDS = (*SEMANTIC_KINDS, "evidence_only", "noise")
LIBRARIES = ("active_tender", "business")
RECORD_KINDS = ("project", "source_document", "business_item", "company_knowledge")
KNOWLEDGE_KINDS = ("business_item", "company_knowledge")
PROJECT_STATES = ("lead", "approved", "bidding", "submitted", "evaluating", "won", "lost", "paused", "terminated", "contracted", "archived")
ARCHIVE_OUTCOMES = ("won_completed", "lost", "terminated", "paused_by_decision")
ACTIVE_STATES = ("lead", "approved", "bidding", "submitted", "evaluating", "won", "contracted", "active")
HISTORICAL_STATES = ("lost", "paused", "terminated", "archived", "completed", "cancelled", "suspended")
#: Allowed project transitions (fixed values).
TRANSITIONS = {
    "lead": ("approved", "lost", "paused", "terminated"),
    "approved": ("bidding", "paused", "terminated"),
    "bidding": ("submitted", "paused", "terminated"),
    "submitted": ("evaluating", "won", "lost", "paused", "terminated"),
    "evaluating": ("won", "lost", "paused", "terminated"),
    "won": ("contracted", "archived"),
    "lost": ("archived",),
    "paused": ("approved", "bidding", "submitted", "evaluating", "terminated", "archived"),
    "terminated": ("archived",),
    "contracted": ("archived",),
    "archived": (),
}
#: The outcome with which a state may be archived (fixed values).
ARCHIVE_OF = {"won": "won_completed", "contracted": "won_completed", "lost": "lost", "terminated": "terminated", "paused": "paused_by_decision"}
#: Production states and their transitions (fixed values).
PRODUCTION = {
    "waiting": ("processing", "failed"),
    "processing": ("pending_confirmation", "stored", "failed"),
    "pending_confirmation": ("processing", "failed"),
    "stored": ("waiting", "failed"),
    "failed": ("waiting", "processing"),
}
#: Categories of the library of active tenders, owned and referred to (fixed values).
ACTIVE_CATEGORIES = (
    "project_overview", "opportunity_customer", "tender_documents_interpretation", "site_survey_original_materials", "bid_strategy_responsibilities",
    "technical_solution", "design_optimization", "construction_organization_schedule", "technical_bid", "commercial_quotation_cost",
    "procurement_subcontracting", "risk_deviation_compliance", "internal_review_decision", "qa_addenda", "bid_document_submission_history",
    "opening_evaluation_award_tracking", "contract_negotiation_signing", "review_knowledge_candidates", "project_correspondence",
    "meeting_minutes_decisions", "project_material_index",
)
ACTIVE_REFERENCES = ("business_common_knowledge_refs", "business_templates_tools_refs")
#: Categories of the business library (fixed values).
BUSINESS_CATEGORIES = (
    "customers", "complete_historical_projects", "proposals_cases", "quotation_cost", "construction_organization_schedules", "risks_issues",
    "failures_terminated_lessons", "talent_experts", "suppliers_subcontractors", "materials_equipment", "standards_specifications", "contracts_legal",
    "technical_methods_workmanship", "quality_acceptance", "safety_civilized_construction", "correspondence_important_decisions",
    "company_systems_processes", "market_competition_intelligence", "templates_tools", "terminology_general_knowledge",
)
ITEM_TYPES = ("requirement", "decision", "commitment", "risk", "issue", "change", "action", "quotation", "material", "method", "acceptance_criterion", "clarification", "contract_obligation", "project_lesson")
DOCUMENT_ROLES = ("source_record", "instruction", "submission", "correspondence", "meeting_record", "commercial_record", "technical_record", "contract_record", "reference", "unknown")
#: Semantic kind: tag, business category, category of active tenders (fixed values).
KIND_TABLE = {
    "fact": ("事实", "terminology_general_knowledge", "project_overview"),
    "requirement": ("要求", "standards_specifications", "tender_documents_interpretation"),
    "decision": ("决策", "correspondence_important_decisions", "internal_review_decision"),
    "action": ("行动", "company_systems_processes", "meeting_minutes_decisions"),
    "process": ("流程", "company_systems_processes", "bid_strategy_responsibilities"),
    "method": ("方法", "technical_methods_workmanship", "technical_solution"),
    "parameter": ("参数", "materials_equipment", "procurement_subcontracting"),
    "risk": ("风险", "risks_issues", "risk_deviation_compliance"),
    "issue": ("问题", "risks_issues", "risk_deviation_compliance"),
    "experience": ("经验", "failures_terminated_lessons", "review_knowledge_candidates"),
    "commercial_term": ("商务条款", "contracts_legal", "commercial_quotation_cost"),
    "schedule": ("计划", "construction_organization_schedules", "construction_organization_schedule"),
    "entity_profile": ("实体", "customers", "opportunity_customer"),
    "correspondence": ("往来", "correspondence_important_decisions", "project_correspondence"),
}
#: Item types of older candidates and their semantic kinds (fixed values).
KIND_OF_ITEM = {"commitment": "requirement", "quotation": "commercial_term", "material": "parameter", "acceptance_criterion": "requirement", "clarification": "correspondence", "contract_obligation": "commercial_term", "project_lesson": "experience"}
#: Tag synonyms (fixed values).
TAG_SYNONYMS = {
    "质量管理": "质量", "品质": "质量", "安全管理": "安全", "工期": "时间", "进度": "时间", "造价": "成本", "报价": "成本", "供应商": "供应链",
    "分包商": "供应链", "施工工艺": "工艺", "技术方法": "工艺", "合同条款": "合同", "规范": "标准", "标准规范": "标准",
    "quality": "质量", "品質管理": "质量", "safety": "安全", "schedule": "时间", "cost": "成本", "price": "成本", "見積": "成本",
    "supplier": "供应链", "サプライヤー": "供应链", "subcontractor": "供应链", "contract": "合同", "契約": "合同", "standard": "标准", "規格": "标准",
    "requirement": "要求", "要求事項": "要求", "risk": "风险", "リスク": "风险",
}
#: Relation: kinds it may come from, kinds it may go to (fixed values).
RELATIONS = {
    "derived_from": (("business_item", "company_knowledge"), ("source_document",)),
    "belongs_to": (("source_document", "business_item"), ("project",)),
    "contains": (("project", "source_document"), ("source_document", "business_item")),
    "related": (RECORD_KINDS, RECORD_KINDS),
    "supersedes": (RECORD_KINDS[1:], RECORD_KINDS[1:]),
    "replaces": (RECORD_KINDS[1:], RECORD_KINDS[1:]),
}
KIND_PREFIX = {"project": "prj", "source_document": "src", "business_item": "bi", "company_knowledge": "ck"}
KIND_FOLDER = {"project": "项目", "source_document": "来源", "business_item": "业务事项", "company_knowledge": "公司知识"}
#: Limits of a plan and of candidate batches (fixed values).
PLAN_LIMITS = {"records": 250, "actions": 600, "links": 40}
BATCH_LIMITS = {"blocks": 12, "requests": 8, "block_text": 6000, "evidence_text": 2000, "items": 40, "reasons": 8, "reason_text": 300}

LOCATOR = "struct<scheme:string,value:string,page:int,sheet:string,`range`:string,row:int,column:string,message_id:string,attachment_id:string,heading_path:array<string>>"
#: Raw blocks, as parsers write them.
RAW_BLOCKS = (
    f"source_document_id string, block_id string, ord int, kind string, text string, fields map<string,string>, hierarchy array<string>, heading_path array<string>, heading string, "
    f"locator {LOCATOR}, provenance array<{LOCATOR}>, parse_status string, card_eligible boolean, exclusion_reason string, metadata map<string,string>"
)
EVIDENCE = f"struct<block_id:string,locator:{LOCATOR},verbatim:string>"


def transitions(spark: SparkSession, table: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """from_state, to_state: a fixed table of a few dozen rows."""
    return spark.createDataFrame([(a, b) for a, to in table.items() for b in to], "from_state string, to_state string")


def categories(spark: SparkSession) -> DataFrame:
    """library, category: a fixed table."""
    rows = [("active_tender", c) for c in (*ACTIVE_CATEGORIES, *ACTIVE_REFERENCES)] + [("business", c) for c in BUSINESS_CATEGORIES]
    return spark.createDataFrame(rows, "library string, category string")


def relation_rules(spark: SparkSession) -> DataFrame:
    """type, from_kind, to_kind: a fixed table."""
    return spark.createDataFrame([(t, a, b) for t, (start, end) in RELATIONS.items() for a in start for b in end], "type string, from_kind string, to_kind string")
