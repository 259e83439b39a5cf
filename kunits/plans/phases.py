"""The candidate pipeline with an injected provider, then the review gate; settings and caches of parsing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kunits.functions.text import clean_text
from kunits.operators import blocks as B
from kunits.operators import candidates as C
from kunits.operators import gate, ops

FACTS = "struct<actors:array<string>,status:array<string>,dates:array<string>,units:array<string>,numbers:array<string>,modality:array<string>>"
ITEMS = (
    f"items array<struct<item_type:string,block_id:string,verbatim:string,summary:string,applicable_conditions:array<string>,facts:{FACTS},reusable:boolean,reuse_reasons:array<string>,"
    "project_id:string,directory_category:string>>"
)
Provider = Callable[[list[dict]], list[dict]]


def run(blocks: DataFrame, documents: DataFrame, registry: DataFrame, extract: Provider | None = None, id_col: str = "source_document_id") -> dict[str, DataFrame]:
    """Candidates of documents and what the gate makes of them.

    *blocks* are canonical with ``card_eligible``; *documents*: id, filename,
    metadata. *extract* gets batches of {batch_key, blocks} and answers with
    {batch_key, items}. Without it no request is made and there are no
    candidates, but routes and batches are there.
    """
    good = B.eligible(blocks)
    matched = C.match_projects(C.project_evidence(documents, good, id_col), C.registry_identities(registry), id_col)
    routes = C.local_route(documents, matched, id_col)
    batched = C.batches(good, id_col)
    requests = C.extraction_input(batched, id_col).withColumn("batch_key", F.concat_ws("#", F.col(id_col).cast("string"), F.col("batch").cast("string")))
    if extract is None:
        answers = requests.select("batch_key", id_col, F.lit(None).cast(ITEMS.split(" ", 1)[1]).alias("items"), F.lit("PROVIDER_NOT_CONFIGURED").alias("error")).where(F.lit(False))
    else:
        answers = ops.provider_map(requests.select("batch_key", "blocks"), "batch_key", extract, ITEMS).join(requests.select("batch_key", id_col), "batch_key")
    raw = answers.where("error is null").select(id_col, "batch_key", F.posexplode("items").alias("nth", "item")).select(id_col, "batch_key", "nth", "item.*")
    found = C.validate(raw, good, id_col)
    route_of = routes.select(id_col, F.col("project_id").alias("r_project"), F.col("directory_category").alias("r_category"), "library", "document_role", F.col("review_reasons").alias("route_reasons"))
    valid = found.where("error is null").join(route_of, id_col, "left")
    invented = (F.col("project_id").isNotNull() & ~F.col("project_id").eqNullSafe(F.col("r_project"))) | (F.col("directory_category").isNotNull() & ~F.col("directory_category").eqNullSafe(F.col("r_category")))
    meta = good.select(id_col, "block_id", F.col("metadata").alias("b_meta"), "ord")
    valid = valid.join(meta, [id_col, "block_id"], "left").withColumns({
        "review_reasons": F.array_compact(F.array(F.when(F.col("reusable").eqNullSafe(True), "reuse_promotion"), F.when(invented, "unsupported_invented_facts"))),
        "facts": C.normalized_facts(F.col("facts")), "boundary": C.boundary_key(F.col("b_meta"), F.col("locator_key"), F.col("block_id")),
        "reuse_reasons": F.coalesce("reuse_reasons", F.array().cast("array<string>")), "project_id": F.col("r_project"), "directory_category": F.col("r_category"),
    })
    done = C.consolidate(valid, id_col).withColumns({
        "evidence_ok": gate.verifiable(F.col("quote"), F.col("block_id"), F.col("block_locator.scheme"), F.col("block_locator.value")),
        "difference_status": F.lit(None).cast("string"), "conflict_signature": gate.critical_signature({k: F.col("facts")[k] for k in ("numbers", "dates", "units", "status")}),
    })
    classified, groups, counts = gate.run(done, enabled=True)
    return {"eligible": good, "routes": routes, "batches": batched, "errors": found.where("error is not null"), "candidates": done, "classified": classified, "groups": groups, "counters": counts, "failed": answers.where("error is not null")}


def repaired_label(column: Column, most: int = 300) -> Column:
    """struct(value, repairs): a label trimmed and collapsed, with the names of the repairs made."""
    value = clean_text(column, most)
    trimmed = F.when(F.coalesce(column, F.lit("")) != F.trim(F.coalesce(column, F.lit(""))), "trimmed")
    collapsed = F.when(F.trim(F.coalesce(column, F.lit(""))).rlike(r"\s{2,}|[\t\r\n]"), "collapsed")
    cut = F.when(F.char_length(F.coalesce(column, F.lit(""))) > most, "cut")
    return F.struct(value.alias("value"), F.array_compact(F.array(trimmed, collapsed, cut)).alias("repairs"))


def ocr_settings(given: dict | None = None) -> dict:
    """Settings of local OCR within their limits, with a fingerprint that names no folder."""
    given = given or {}
    clamp = lambda k, usual, low, high: max(low, min(high, type(usual)(given.get(k) if given.get(k) is not None else usual)))
    made = {
        "provider": given.get("provider", "tesseract"), "languages": str(given.get("languages", "chi_sim+eng"))[:64], "executable": str(given.get("executable", "tesseract")).replace("\\", "/").rsplit("/", 1)[-1],
        "quality_threshold": clamp("quality_threshold", 0.75, 0.0, 1.0), "workers": clamp("workers", 2, 1, 8), "dpi": clamp("dpi", 200, 72, 600), "timeout_ms": clamp("timeout_ms", 60_000, 1_000, 600_000),
    }
    return made | {"fingerprint": hashlib.sha256(json.dumps(made, sort_keys=True, ensure_ascii=False).encode()).hexdigest()}


def clear_cache(spark: SparkSession, root: str, managed: str = "kunits") -> int:
    """Delete what is in the managed folder of intermediate tables, nothing else; the number of entries deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{managed}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    entries = list(fs.listStatus(path))
    for entry in entries:
        fs.delete(entry.getPath(), True)
    return len(entries)


def bounded_chunks(chars: Column, most: int = 10_000) -> Column:
    """How many chunks a text of so many characters makes."""
    return F.greatest(F.ceil(chars / most), F.lit(1)).cast("int")
