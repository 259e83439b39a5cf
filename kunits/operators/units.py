"""Knowledge units: planning, dedupe, routing, tags, coverage, relations, review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.functions import lang
from kunits.functions.text import unique_first
from kunits.operators.segment import merge_adjacent, said, shown
from kunits.schema import ACTIVE_STATES, HISTORICAL_STATES, KIND_OF_ITEM, KIND_TABLE, SEMANTIC_KINDS, TAG_SYNONYMS

REUSABLE_KINDS = ("method", "process", "experience", "requirement")
THIS_PROJECT = r"(?i)(本项目|本工程|this\s+project)"
MERGED = "相邻且主题、范围、责任和语义类型兼容"
DUPLICATE = "确定性指纹重复"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def kind_of(semantic_kind: Column, item_type: Column) -> Column:
    """A known semantic kind, else that of the older item type, else ``fact``."""
    return F.when(semantic_kind.isin(*SEMANTIC_KINDS), semantic_kind).otherwise(F.coalesce(_map(KIND_OF_ITEM)[item_type], F.lit("fact")))


def route_unit(kind: Column, lifecycle: Column, project_specific: Column, reusable: Column, explicit: Column | None = None) -> Column:
    """struct(library, category, confidence, ambiguous) of a unit."""
    state = F.lower(F.trim(F.coalesce(lifecycle, F.lit(""))))
    past, active = state.isin(*HISTORICAL_STATES), state.isin(*ACTIVE_STATES)
    explicit = F.lit(None).cast("string") if explicit is None else F.when(explicit.isin("active_tender", "business"), explicit)
    unsure = ~past & project_specific & ~active & (state == "unknown") & explicit.isNull()
    derived = F.when(past, "business").when(project_specific & active, F.when(reusable, "business").otherwise("active_tender")).when(project_specific & (state == "unknown"), "business").when(project_specific, "active_tender").otherwise("business")
    library = F.coalesce(explicit, derived)
    category = F.when(library == "active_tender", _map({k: v[2] for k, v in KIND_TABLE.items()})[kind]).otherwise(_map({k: v[1] for k, v in KIND_TABLE.items()})[kind])
    return F.struct(library.alias("library"), category.alias("category"), F.when(unsure, 0.45).otherwise(0.9).alias("confidence"), unsure.alias("ambiguous"))


def normalize_tags(candidates: Column, existing: Column | None = None, most: int = 10) -> Column:
    """Tags in order of first appearance: split at commas and slashes, without #, synonyms joined, in known case."""
    parts = F.flatten(F.transform(candidates, lambda c: F.split(F.coalesce(c, F.lit("")), "[,，/]")))
    bare = F.transform(parts, lambda t: F.regexp_replace(F.substring(F.trim(t), 1, 40), "^#+", ""))
    same = F.transform(bare, lambda t: F.coalesce(_map(TAG_SYNONYMS)[t], t))
    good = F.filter(same, lambda t: (t != "") & (F.char_length(t) <= 20) & ~t.rlike(r"[\n\[\]{}]"))
    if existing is not None:
        good = F.transform(good, lambda t: F.coalesce(F.try_element_at(F.filter(existing, lambda e: F.lower(e) == F.lower(t)), F.lit(-1)), t))
    return F.slice(F.array_distinct(good), 1, most)


def _merged(rows: DataFrame, id_col: str, carried: list[str], kept: list[str], chars: Column | None = None) -> DataFrame:
    """Adjacent compatible regions as one: their *carried* columns in order of segments (parts), projects, region_ids, ord and fingerprint.

    Rows: regions that aren't noise, with what their document's profile says, ``shown`` and ``statement`` or *chars*.
    """
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"projects": unique_first(F.concat(F.coalesce("project_scope", none), F.coalesce("project_ids", none))), "status": F.coalesce("lifecycle", F.lit(""))}).where(F.size("shown") > 0)
    rows = rows.withColumn("scope", F.when(F.size("projects") > 0, "project").otherwise("general"))
    rows = merge_adjacent(rows, ["semantic_kind", "subject", "scope", "status"], id_col, "segment", "statement" if chars is None else None, chars=chars)
    one = F.array_sort(F.collect_list(F.struct("segment", "region_id", "fingerprint", "projects", "shown", *carried)))
    merged = rows.groupBy(id_col, "merged", "semantic_kind", "scope", "status").agg(one.alias("parts"), *(F.first(c).alias(c) for c in kept))
    p = lambda c: F.transform("parts", lambda x: x[c])
    merged = merged.withColumns({"projects": F.col("parts")[0]["projects"], "region_ids": p("region_id"), "ord": F.col("parts")[0]["segment"]})
    told = F.struct(F.flatten(p("shown")).alias("evidence"), F.col("semantic_kind").alias("kind"), F.col("projects").alias("projectIds"), F.array_join(p("fingerprint"), ",").alias("source_meaning"))
    return merged.withColumn("fingerprint", F.sha2(F.to_json(told), 256))


def _distinct(merged: DataFrame, id_col: str, joined: list[str]) -> DataFrame:
    """Of equal fingerprints the first; ``every_`` column of *joined* has those of all."""
    same = merged.groupBy(id_col, "fingerprint").agg(F.min_by(F.struct("*"), "ord").alias("u"), F.array_sort(F.collect_list(F.struct("ord", *joined))).alias("all"))
    return same.select("u.*", *(F.flatten(F.col("all")[c]).alias(f"every_{c}") for c in joined))


def _unit_id() -> Column:
    return F.concat(F.lit("ku-"), F.substring("fingerprint", 1, 24))


def outlined(regions: DataFrame, id_col: str = "source_document_id", explicit_library: str | None = None) -> DataFrame:
    """Of the units that :func:`units` makes: id, unit_id, fingerprint, ord, region_ids, route (only whether it is ambiguous), uncertainty.

    *regions* are outlines (:func:`segment.outline`) of documents without metadata.
    """
    rows = regions.where("semantic_kind <> 'noise'").withColumn("project_scope", F.array().cast("array<string>"))
    merged = _merged(rows, id_col, [], [], F.col("chars")).drop("parts")
    done = _distinct(merged, id_col, ["region_ids"])
    route = route_unit(F.col("semantic_kind"), F.col("status"), F.col("scope") == "project", F.lit(False), F.lit(explicit_library) if explicit_library else None)
    return done.select(
        id_col, _unit_id().alias("unit_id"), "fingerprint", "ord", F.col("every_region_ids").alias("region_ids"), F.struct(route["ambiguous"].alias("ambiguous")).alias("route"), F.array().cast("array<string>").alias("uncertainty")
    )


def units(regions: DataFrame, profiles: DataFrame, id_col: str = "source_document_id", explicit_library: str | None = None) -> DataFrame:
    """Units of knowledge from regions: adjacent compatible ones merged, equal ones joined, routed and tagged.

    Columns: id, unit_id, fingerprint, ord, title, statement, semantic_kind,
    subject, scope, project_ids, evidence, region_ids, structured_facts,
    source_language, reusable, status, authority, route, tags, uncertainty.
    Regions may carry ``translated_text``. Equality is by kind, text, projects
    and evidence, so equal texts of different blocks stay apart.
    """
    rows = regions.where("semantic_kind <> 'noise'").join(profiles.select(id_col, "project_scope", "lifecycle", "authority", "business_domains"), id_col, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "statement": said(regions), "shown": shown(F.col("blocks")),
        "evidence": F.transform(F.filter("blocks", lambda b: b["text"] != ""), lambda b: F.struct(b["block_id"].alias("block_id"), b["locator"].alias("locator"), b["text"].alias("verbatim"))),
    })
    merged = _merged(rows, id_col, ["subject", "statement", "text", "evidence"], ["authority", "business_domains"])
    p = lambda c: F.transform("parts", lambda x: x[c])
    merged = merged.withColumns({
        "subject": F.col("parts")[0]["subject"], "statement": F.array_join(p("statement"), "\n"), "original": F.array_join(p("text"), "\n"), "evidence": F.flatten(p("evidence")),
    }).drop("parts")
    first = F.coalesce(F.nullif(F.regexp_extract("statement", r"^([^。；;\n]*)", 1), F.lit("")), F.lit("知识单元"))
    merged = merged.withColumns({
        "title": F.coalesce(F.nullif(F.substring("subject", 1, 180), F.lit("")), F.substring(first, 1, 120)),
        "reusable": F.col("semantic_kind").isin(*REUSABLE_KINDS) & ~F.col("original").rlike(THIS_PROJECT),
    })
    # Equal fingerprints: the first stays and takes the others' evidence and regions.
    done = _distinct(merged, id_col, ["evidence", "region_ids"])
    done = done.withColumn("route", route_unit(F.col("semantic_kind"), F.col("status"), F.col("scope") == "project", F.col("reusable"), F.lit(explicit_library) if explicit_library else None))
    tags = F.concat(F.array(_map({k: v[0] for k, v in KIND_TABLE.items()})[F.col("semantic_kind")]), F.coalesce("business_domains", none), F.col("projects"), F.array(F.when(F.col("route.library") == "active_tender", "在办").otherwise("业务知识")))
    return done.select(
        id_col, _unit_id().alias("unit_id"), "fingerprint", "ord", "title", "statement", F.col("original").alias("original_statement"), "semantic_kind", "subject", "scope",
        F.col("projects").alias("project_ids"), none.alias("entity_ids"), F.col("every_evidence").alias("evidence"), F.col("every_region_ids").alias("region_ids"), lang.extract_facts(F.col("statement")).alias("structured_facts"),
        lang.detect_language(F.col("original"))["language"].alias("source_language"), "reusable", "status", "authority", "route", normalize_tags(tags).alias("tags"), none.alias("uncertainty"),
    )


def coverage(regions: DataFrame, planned: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """region_id, status, unit_id, reason: every region is covered, merged or dropped."""
    held = planned.select(id_col, "unit_id", F.posexplode("region_ids").alias("nth", "region_id"))
    held = held.groupBy(id_col, "region_id").agg(F.min_by(F.struct("unit_id", "nth"), "nth").alias("h"))
    rows = regions.select(id_col, "region_id", "semantic_kind", "dropped_reason").join(held, [id_col, "region_id"], "left")
    status = F.when(F.col("semantic_kind") == "noise", "dropped").when(F.col("h").isNull(), "missing").when(F.col("h.nth") > 0, "merged").otherwise("covered")
    reason = F.when(status == "dropped", F.coalesce(F.nullif("dropped_reason", F.lit("")), F.lit("非可复用噪声"))).when(status == "merged", MERGED)
    return rows.select(id_col, "region_id", status.alias("status"), F.when(status != "dropped", F.col("h.unit_id")).alias("unit_id"), reason.alias("reason"))


def coverage_gaps(regions: DataFrame, ledger: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """Regions without a valid row in the coverage ledger."""
    return regions.join(ledger.where(F.col("status").isin("covered", "merged", "dropped")), [id_col, "region_id"], "left_anti")


def repaired(regions: DataFrame, profiles: DataFrame, planned: DataFrame, ledger: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """Units with those of the regions that the ledger misses."""
    return planned.unionByName(units(coverage_gaps(regions, ledger, id_col), profiles, id_col))


def shared_identity_pairs(rows: DataFrame, key: str, identity: str, order: str, most: int | None = None) -> DataFrame:
    """from, to, identity: pairs of different keys that share an identity, earlier first.

    The output grows with the square of an identity's rows; *most* refuses
    (it doesn't cut) identities of more rows: they come back by :func:`crowded`.
    """
    some = rows.select(identity, key, order).distinct()
    if most is not None:
        some = some.withColumn("_n", F.count("*").over(W.partitionBy(identity))).where(F.col("_n") <= most).drop("_n")
    a, b = some.select(identity, F.col(key).alias("from_id"), F.col(order).alias("a")), some.select(identity, F.col(key).alias("to_id"), F.col(order).alias("b"))
    return a.join(b, identity).where((F.col("a") < F.col("b")) & (F.col("from_id") != F.col("to_id"))).select("from_id", "to_id", identity)


def crowded(rows: DataFrame, key: str, identity: str, most: int) -> DataFrame:
    """identity, members: identities of more than *most* keys."""
    return rows.groupBy(identity).agg(F.count_distinct(key).alias("members")).where(F.col("members") > most)


def _identities(planned: DataFrame, id_col: str) -> DataFrame:
    """unit_id, place, identity: a row for each project and entity of a unit."""
    return planned.select("unit_id", F.concat_ws("\x1f", F.col(id_col).cast("string"), F.lpad(F.col("ord").cast("string"), 9, "0")).alias("place"), F.explode(F.array_distinct(F.concat("project_ids", "entity_ids"))).alias("identity"))


def crowded_members(planned: DataFrame, id_col: str = "source_document_id", most: int = 40) -> DataFrame:
    """identity, place, unit_id: all units of the identities that :func:`relations` refuses, of the same *most*.

    Each two of an identity with different ids are related, the earlier place
    first; the rows grow with the units, not with their pairs.
    """
    some = _identities(planned, id_col).distinct().withColumn("_n", F.count("*").over(W.partitionBy("identity")))
    return some.where(F.col("_n") > most).select("identity", "place", "unit_id")


def relations(planned: DataFrame, id_col: str = "source_document_id", most: int = 40) -> DataFrame:
    """Edges between units that share a project or entity: from_unit_id, to_unit_id, type, confidence, evidence.

    Identities of more than *most* units come back whole by :func:`crowded_members`.
    """
    pairs = shared_identity_pairs(_identities(planned, id_col), "unit_id", "identity", "place", most)
    return pairs.select(F.col("from_id").alias("from_unit_id"), F.col("to_id").alias("to_unit_id"), F.lit("related").alias("type"), F.lit(1.0).alias("confidence"), F.struct(F.lit("shared_explicit_identity").alias("kind"), F.col("identity").alias("value")).alias("evidence"))


def review_groups(planned: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """review_id, cause, unit_ids (in order): units grouped by why they need review."""
    causes = F.array_compact(F.array(F.when(F.col("route.ambiguous"), "ambiguous_library_route"), F.when(F.array_contains("uncertainty", "material_conflict"), "material_conflict")))
    rows = planned.select(id_col, "ord", "unit_id", F.explode(causes).alias("cause"))
    grouped = rows.groupBy(id_col, "cause").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "unit_id"))), lambda u: u["unit_id"]).alias("unit_ids"))
    return grouped.withColumn("review_id", F.concat(F.lit("review-"), F.substring(F.sha2(F.to_json(F.array(F.col(id_col).cast("string"), F.col("cause"))), 256), 1, 20)))


def telemetry(blocks: DataFrame | None, regions: DataFrame, planned: DataFrame, ledger: DataFrame, reviews: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """One row a document that has blocks: blocks, regions, units, coverage, compression, accepted, review, rejected.

    What each table counts is put under one another and added up by document
    at once, so five tables cost one shuffle of counts. Without *blocks*
    regions have their number as ``parse_blocks``.
    """
    noise, one = F.col("semantic_kind") == "noise", F.lit(1)
    counted = [
        *([(blocks, {"parse_blocks": one})] if blocks is not None else []),
        (regions, {"semantic_regions": one, "meaningful": (~noise).cast("int"), "rejected": noise.cast("int"), **({"parse_blocks": F.col("parse_blocks")} if blocks is None else {})}), (planned, {"planned_units": one}),
        (ledger, {"covered": F.col("status").isin("covered", "merged").cast("int")}), (reviews, {"review": one, "held": F.size("unit_ids")}),
    ]
    names = [name for _, counts in counted for name in counts]
    parts = [df.select(id_col, *(counts.get(name, F.lit(0)).cast("long").alias(name) for name in names)) for df, counts in counted]
    rows = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names)).where("parse_blocks > 0")
    share = lambda part, usual: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col("meaningful").cast("double")), F.lit(usual))
    return rows.select(
        id_col, "parse_blocks", "semantic_regions", "planned_units", share("covered", 1.0).alias("semantic_coverage"), share("planned_units", 0.0).alias("compression_ratio"),
        (F.col("planned_units") - F.col("held")).alias("accepted"), "review", "rejected",
    )
