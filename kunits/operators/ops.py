"""Operations: failures, cohorts, rollups, event ranges, retention, reports, approvals, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kunits.session import parts_of

#: HTTP statuses worth another try, besides all of 5xx (fixed values).
TRANSIENT = (408, 425, 429, 529)
#: Failure rules in order: pattern of code or status, stable code, category, retryable (fixed values).
FAILURES = (
    (r"^(401|403)$|unauthori[sz]ed|forbidden|invalid api key", "AUTH_FAILED", "configuration", False), (r"^(408|504)$|timeout|timed out|etimedout", "TIMEOUT", "network", True),
    (r"^(429|529)$|rate.?limit|too many requests|overloaded", "RATE_LIMITED", "provider", True), (r"^5\d\d$|bad gateway|unavailable", "PROVIDER_UNAVAILABLE", "provider", True),
    (r"econnreset|enotfound|econnrefused|network|socket", "NETWORK", "network", True), (r"abort|cancel", "CANCELLED", "user", False), (r"json|parse|schema|malformed", "BAD_RESPONSE", "provider", True),
    (r"enospc|eacces|eperm|erofs|disk", "STORAGE", "environment", False), (r"^4\d\d$", "BAD_REQUEST", "request", False),
)
ISSUES = {"missing_evidence": "evidence", "quote_not_found": "evidence", "ambiguous_quote": "evidence", "conflicting_facts": "conflict", "critical_fact_conflict": "conflict", "ambiguous_project": "routing", "ambiguous_category": "routing", "route_incomplete": "routing", "reuse_promotion": "reuse", "unsupported_invented_facts": "unsupported"}


def transient(status: Column) -> Column:
    return status.isin(*TRANSIENT) | status.between(500, 599)


def classify_failure(status: Column, message: Column) -> Column:
    """struct(code, category, retryable): the first rule that the status or the message meets."""
    out = F.struct(F.lit("UNKNOWN").alias("code"), F.lit("unknown").alias("category"), F.lit(False).alias("retryable"))
    s, m = F.coalesce(status.cast("string"), F.lit("")), F.lower(F.coalesce(message, F.lit("")))
    for pattern, code, category, again in reversed(FAILURES):
        out = F.when(s.rlike(pattern) | m.rlike(pattern), F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(again).alias("retryable"))).otherwise(out)
    return out


def errors_by_code(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def explain_issue(reason: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ISSUES.items() for x in pair))[reason], F.lit("other"))


def stratified_sample(rows: DataFrame, key: Column, strata: list[str], limit: int, seed: str = "") -> DataFrame:
    """*limit* rows, dealt from the strata in turn: the same whatever the order of the rows.

    Ranked within strata first, so the last sort only sees *limit* rows a stratum.
    """
    drawn = F.sha2(F.concat(F.lit(seed + "|"), key.cast("string")), 256)
    rows = rows.withColumn("_draw", drawn).withColumn("_turn", F.row_number().over(W.partitionBy(*strata).orderBy("_draw"))).where(F.col("_turn") <= limit)
    return rows.orderBy("_turn", *strata, "_draw").limit(limit).drop("_draw", "_turn")


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size(F.coalesce("review_ids", F.array().cast("array<string>")))).alias("reviews"))


def shadow_delta(runs: DataFrame, baseline: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Means of the measures of both sides and their differences."""
    mean = lambda df, side: df.groupBy(*by).agg(*(F.avg(m).alias(f"{side}_{m}") for m in measures))
    rows = mean(runs, "run").join(mean(baseline, "base"), by, "full")
    return rows.select(*by, *(F.col(f"{s}_{m}") for m in measures for s in ("run", "base")), *((F.col(f"run_{m}") - F.col(f"base_{m}")).alias(f"delta_{m}") for m in measures))


def event_ranges(events: DataFrame, partition: list[str], order: list[str], scope: str) -> DataFrame:
    """Runs of events of one scope as ranges: first, last, hits."""
    w = W.partitionBy(*partition).orderBy(*order)
    new = F.coalesce(F.lag(scope).over(w) != F.col(scope), F.lit(True)).cast("int")
    rows = events.withColumn("range_no", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*partition, "range_no", scope).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("hits"))


def retained(rows: DataFrame, partition: list[str], at: str, key: str, most: int, days: int, now: Column) -> DataFrame:
    """The newest *most* rows of each partition that aren't older than *days*: retention is the feature."""
    w = W.partitionBy(*partition).orderBy(F.desc(at), key)
    return rows.where(F.col(at) >= now - F.make_dt_interval(F.lit(days))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def queue_position(tasks: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Adds position (from 1) of waiting tasks and the run's mean progress."""
    waiting = F.col("status") == "waiting"
    nth = F.row_number().over(W.partitionBy(*partition, waiting).orderBy(*order))
    return tasks.withColumns({"position": F.when(waiting, nth), "run_percent": F.avg("percent").over(W.partitionBy(*partition))})


def page(rows: DataFrame, order: list[str], number: int, size: int = 50) -> DataFrame:
    """One page of a list; pages count from 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def bounded_report(events: DataFrame, partition: list[str], order: list[str], budget: int = 64 * 1024) -> DataFrame:
    """The newest events whose JSON fits into *budget* bytes: the oldest are dropped."""
    w = W.partitionBy(*partition).orderBy(*(F.desc(c) for c in order)).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("_size", F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1).over(w)).where(F.col("_size") <= budget - 2).drop("_size")


def approval_plan(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that may be approved together, the others): pending, with evidence, matched, without a hard gate."""
    ok = (F.col("status") == "pending") & F.col("has_evidence") & F.col("consistency").isin("matched", "not_applicable") & (F.size("hard_gates") == 0)
    rows = items.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return rows.where("_ok").drop("_ok"), rows.where("not _ok").drop("_ok")


def confidence(weights: dict[str, float], hard: list[Column], threshold: float = 0.9) -> Column:
    """struct(score, decision): weighted components (columns of these names), auto_ingest or review.

    Any hard rule sends to review; the threshold is held within 0.7 and 1.
    The weights are configuration.
    """
    total = sum(weights.values())
    score = sum((F.coalesce(F.col(k), F.lit(0.0)) * (v / total) for k, v in weights.items()), F.lit(0.0))
    blocked = F.lit(False)
    for rule in hard:
        blocked = blocked | F.coalesce(rule, F.lit(True))
    return F.struct(F.round(score, 6).alias("score"), F.when(~blocked & (score >= min(1.0, max(0.7, threshold))), "auto_ingest").otherwise("review").alias("decision"))


def validation_report(gates: dict[str, Column]) -> Column:
    """struct(failed, decision): names of the hard gates that hold."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), name) for name, c in gates.items())))
    return F.struct(failed.alias("failed"), F.when(F.size(failed) > 0, "review").otherwise("pass").alias("decision"))


def stage_metric(started: Column, ended: Column, text: Column) -> Column:
    """struct(ms, estimated_tokens, hash): 300 characters are about 100 tokens."""
    return F.struct(((F.unix_micros(ended) - F.unix_micros(started)) / 1000).cast("long").alias("ms"), F.ceil(F.char_length(text) / 3).alias("estimated_tokens"), F.substring(F.sha2(text, 256), 1, 12).alias("hash"))


def hierarchical_summary(chunks: DataFrame, doc: str, summarize: Callable[[list[str]], str], budget: int = 8000, fan: int = 8) -> DataFrame:
    """doc, summary, ids: summaries of chunks, reduced level by level under a size budget.

    *chunks*: doc, chunk_no, chunk_id, text. The provider is given lists of
    texts; covered ids are the exact union. Levels are joined *fan* at a time,
    so no task holds more than *fan* texts of *budget* characters.
    """
    key = chunks.schema[doc].dataType.simpleString()

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        ids = sorted({i for some in pdf["ids"] for i in some})
        return pd.DataFrame([(pdf[doc].iloc[0], int(pdf["nth"].iloc[0]) // fan, summarize([t[:budget] for t in pdf["text"]]), ids)], columns=[doc, "nth", "text", "ids"])

    rows = chunks.select(doc, F.col("chunk_no").cast("int").alias("nth"), "text", F.array("chunk_id").alias("ids"))
    most = (rows.agg(F.max("nth")).head()[0] or 0) + 1
    while True:
        rows = rows.groupBy(doc, F.floor(F.col("nth") / fan).alias("_g")).applyInPandas(reduce, f"{doc} {key}, nth int, text string, ids array<string>")
        most = -(-most // fan)
        if most <= 1:
            return rows.select(doc, F.col("text").alias("summary"), "ids")


def provider_map(rows: DataFrame, key: str, request: Callable[[list[dict]], list[dict]] | None, schema: str, size: int = 8) -> DataFrame:
    """Rows sent to a provider in batches of *size* (1 to 20); without a provider none is called.

    Each answer must have the ids of its batch, no more and no fewer; a batch
    that fails gives rows with ``error``, and its siblings go on.
    """
    size = max(1, min(20, size))
    names = T.StructType.fromDDL(schema).fieldNames()
    full = f"{key} string, {schema}, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), size):
                batch = pdf.iloc[at : at + size].to_dict("records")
                ids = [str(r[key]) for r in batch]
                try:
                    if request is None:
                        raise RuntimeError("PROVIDER_NOT_CONFIGURED")
                    answers = request(batch)
                    if sorted(str(a[key]) for a in answers) != sorted(ids):
                        raise RuntimeError("PROVIDER_IDS_INVALID")
                    out = [{key: str(a[key]), **{n: a.get(n) for n in names}, "error": None} for a in answers]
                except Exception as e:  # a failed batch is data: its rows carry the error
                    out = [{key: i, **dict.fromkeys(names), "error": str(e)} for i in ids]
                yield pd.DataFrame(out, columns=[key, *names, "error"])

    return rows.mapInPandas(run, full)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a result yet: only failed and missing ones run again."""
    return rows.join(done.where("error is null").select(key), key, "left_anti")


def complete(rows: DataFrame, done: DataFrame, doc: str, key: str) -> DataFrame:
    """doc, complete: whether all of a document's rows have a result."""
    good = done.where("error is null").select(F.col(key), F.lit(1).alias("_ok"))
    return rows.join(good, key, "left").groupBy(doc).agg((F.count("*") == F.count("_ok")).alias("complete"))


def regeneration_plan(selected: DataFrame, atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points to make again, selected cards that are refused): closed for points that others share."""
    points = atoms.select("card_id", F.explode("point_ids").alias("point_id"))
    parts = parts_of(points)
    points = points.repartition(parts, "card_id")
    mine = points.join(selected.select("card_id"), "card_id", "left_semi")
    shared = points.join(selected.select("card_id"), "card_id", "left_anti").select("point_id").distinct()
    sharing = mine.repartition(parts, "point_id").join(shared, "point_id", "left_semi").select("card_id")
    refused = sharing.unionByName(selected.select("card_id").join(points.select("card_id"), "card_id", "left_anti")).repartition(parts, "card_id").distinct()
    return mine.join(refused, "card_id", "left_anti").select("point_id").repartition(parts, "point_id").distinct(), refused


def translation_requests(regions: DataFrame, cache: DataFrame, prompt: str = "universal-zh-v1", model: str = "configured-provider") -> tuple[DataFrame, DataFrame]:
    """(regions with their translation: none needed, cached or deterministic; regions for the provider)."""
    from kunits.functions import lang

    key = F.sha2(F.to_json(F.array(F.regexp_replace("text", r"\s+", " "), F.col("source_language.language"), F.lit("zh-CN"), F.lit(prompt), F.lit(model))), 256)
    rows = regions.where("semantic_kind <> 'noise'").withColumns({"cache_key": key, "_local": lang.deterministic_chinese(F.col("text"))})
    rows = rows.join(cache.select("cache_key", F.col("translated_text").alias("_cached")), "cache_key", "left")
    zh = F.col("source_language.language") == "zh"
    text = F.when(zh, F.col("text")).when(F.col("_cached").isNotNull(), F.col("_cached")).when(F.col("_local.safe"), F.col("_local.text"))
    how = F.when(zh, "source-zh").when(F.col("_cached").isNotNull(), "cache").when(F.col("_local.safe"), "deterministic")
    rows = rows.withColumns({"translated_text": text, "provenance": how}).drop("_cached", "_local")
    return rows.where("translated_text is not null"), rows.where("translated_text is null").withColumn("preserve_exactly", lang.protected_tokens(F.col("text")))


def id_sets_match(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, problem: missing, extra or duplicate ids; empty if the sets match."""
    e, a = expected.select(key).distinct().withColumn("e", F.lit(True)), actual.groupBy(key).agg(F.count("*").alias("n"))
    rows = e.join(a, key, "full")
    return rows.withColumn("problem", F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("n") > 1, "duplicate")).where("problem is not null").select(key, "problem")


def fuzzy_route(names: DataFrame, table: DataFrame) -> DataFrame:
    """name, route: exact, else the table's key in the name, else the name in a key, else without brackets; interpretation."""
    bare = lambda c: F.regexp_replace(c, r"[（(\[【].*?[）)\]】]", "")
    rows = names.join(F.broadcast(table), how="cross")  # a fixed table of a few dozen routes
    n, k = F.col("name"), F.col("key")
    rank = F.when(n == k, 0).when(F.contains(n, k), 1).when(F.contains(k, n), 2).when(bare(n) == bare(k), 3)
    best = rows.withColumn("rank", rank).where("rank is not null").groupBy("name").agg(F.min_by("route", F.struct("rank", "key")).alias("route"))
    return names.join(best, "name", "left")


def compose_prompt(parts: Column, common: Column) -> Column:
    """Rules as one text, each once, those in common first."""
    return F.array_join(F.array_distinct(F.filter(F.concat(common, parts), lambda p: F.trim(p) != "")), "\n")


def index_page(records: DataFrame) -> DataFrame:
    """library, markdown: an index page of each library's records by category."""
    line = F.concat(F.lit("- [["), "record_id", F.lit("|"), "title", F.lit("]]"))
    per = records.groupBy("library", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return per.groupBy("library").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", F.concat(F.lit("## "), "category", F.lit("\n\n"), "body").alias("s")))), lambda x: x["s"]), "\n\n").alias("markdown"))


def entity_rollup(cards: DataFrame) -> DataFrame:
    """entity, cards, projects."""
    return cards.withColumn("entity", F.explode("entities")).groupBy("entity").agg(F.array_sort(F.collect_set("card_id")).alias("cards"), F.array_sort(F.collect_set("project")).alias("projects"))


def persisted_settings(row: DataFrame, secrets: tuple[str, ...] = ("api_key", "token", "password", "secret")) -> DataFrame:
    return row.drop(*(c for c in row.columns if any(s in c.lower() for s in secrets)))


def component_path_problem(path: Column) -> Column:
    """Why a component's path is refused; null if it is fine."""
    return F.when(F.trim(F.coalesce(path, F.lit(""))) == "", "empty").when(path.endswith("/"), "trailing_slash").when(path.startswith("/") | path.rlike(r"^[A-Za-z]:"), "absolute").when(path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "traversal").when(~path.rlike(r"\.(json|md|js|txt|ya?ml)$"), "extension")


def counters(spark: SparkSession) -> dict:
    """Accumulators of the eight operation counters."""
    names = ("api_requests", "prompt_characters", "bytes_read", "bytes_written", "ledger_writes", "artifact_writes", "ui_full_renders", "ui_incremental_refreshes")
    return {n: spark.sparkContext.accumulator(0) for n in names}


def service_test_ok(ok: Column, code: Column, tested_at: Column) -> Column:
    return ok.isNotNull() & code.isNotNull() & tested_at.isNotNull()


def contracts(user: DataFrame, builtin: DataFrame, key: str = "name") -> DataFrame:
    """name, content, origin: a user's file wins, also an invalid one; missing ones are the built-in's."""
    u, b = user.select(key, F.col("content").alias("u")), builtin.select(key, F.col("content").alias("b"))
    rows = b.join(u, key, "full")
    valid = F.try_parse_json(F.coalesce("u", "b")).isNotNull()
    return rows.select(key, F.coalesce("u", "b").alias("content"), F.when(F.col("u").isNotNull(), "user").otherwise("builtin").alias("origin"), valid.alias("valid"))
