"""Queries that call one operator each over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kunits.functions import lang, numbers, text
from kunits.operators import candidates, gate, ops, provenance, records, split, tables, units
from kunits.plans import commit, writer
from kunits.plans.queries import _t, query
from kunits.schema import KIND_FOLDER, KIND_PREFIX, PRODUCTION
from kunits.streaming import events as E


def _q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


_CONTROL = r"'[\x00-\x1f\x7f]', '', 'g'"
_SPACE = r"[\s\x0b]"


@query(f"SELECT doc_id, sha256(left(trim(regexp_replace(text, {_CONTROL})), 8000)) AS hash FROM documents")
def clean_universal(spark: SparkSession, sf: str) -> DataFrame:
    """P-01."""
    return _t(spark, sf, "documents").select("doc_id", text.digest(text.clean(F.col("text"))).alias("hash"))


@query(f"SELECT doc_id, sha256(left(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')), 1000)) AS hash FROM documents")
def clean_phase(spark: SparkSession, sf: str) -> DataFrame:
    """P-02."""
    return _t(spark, sf, "documents").select("doc_id", text.digest(text.clean_text(F.col("text"))).alias("hash"))


@query(f"SELECT doc_id, sha256(left(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 2000)) AS hash FROM documents")
def verbatim_text(spark: SparkSession, sf: str) -> DataFrame:
    """P-03."""
    return _t(spark, sf, "documents").select("doc_id", text.digest(text.verbatim(F.col("text"))).alias("hash"))


@query(f"SELECT doc_id, sha256(left(regexp_replace(trim(text), {_CONTROL}), 500)) AS hash FROM documents")
def writer_text(spark: SparkSession, sf: str) -> DataFrame:
    """P-04."""
    return _t(spark, sf, "documents").select("doc_id", text.digest(text.clean_writer(F.col("text"))).alias("hash"))


@query(rf"SELECT doc_id, sha256(regexp_replace(lower(left(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')), 500)), '[\s\-_.:/\\()\[\]{{}}]+', '', 'g')) AS key FROM documents")
def identity_keys(spark: SparkSession, sf: str) -> DataFrame:
    """P-05."""
    return _t(spark, sf, "documents").select("doc_id", text.digest(text.identity_key(F.col("text"))).alias("key"))


_SEGMENT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(regexp_replace(trim(x), '[\x00-\x1f\x7f]', '', 'g'), 120), '[\\/:*?"<>|#\[\]^]', '-', 'g'), '\.\.', '-', 'g'), '\s+', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g')"""


@query(f"SELECT doc_id, CASE WHEN s = '' THEN '未命名' ELSE s END AS segment FROM (SELECT doc_id, {_SEGMENT} AS s FROM (SELECT doc_id, string_split(text, chr(10))[1] AS x FROM documents))")
def safe_segments(spark: SparkSession, sf: str) -> DataFrame:
    """P-11: titles of documents, their first lines, as segments of paths."""
    return _t(spark, sf, "documents").select("doc_id", text.safe_segment(F.split("text", "\n")[0]).alias("segment"))


_PAGE_PATH = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN regexp_replace(url, '^[a-z]+://([^?#]*).*$', '\\1') ELSE '../' || page_id || '.md' END"


def _page_path() -> F.Column:
    """Paths of four kinds made of the pages' urls."""
    url, kind = F.col("url"), F.col("page_id") % 4
    return F.when(kind == 0, url).when(kind == 1, F.regexp_replace(url, "^[a-z]+://", "")).when(kind == 2, F.regexp_replace(url, "^[a-z]+://([^?#]*).*$", "$1")).otherwise(F.concat(F.lit("../"), F.col("page_id").cast("string"), F.lit(".md")))


@query(rf"""
WITH p AS (SELECT page_id, left(replace({_PAGE_PATH}, chr(92), '/'), 1000) AS raw FROM pages), b AS (SELECT *, regexp_replace(raw, '/+$', '') AS bare FROM p)
SELECT page_id, NOT (raw = '' OR starts_with(raw, '/') OR regexp_matches(raw, '^[A-Za-z]:/') OR bare = '' OR regexp_matches(bare, '(^|/)(\.{{0,2}})(/|$)') OR regexp_matches(bare, '[\x00-\x1f\x7f:*?"<>|]')) AS safe FROM b""")
def safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    """P-11, F-11: paths made of urls."""
    return _t(spark, sf, "pages").select("page_id", text.path_safe(_page_path()).alias("safe"))


@query(rf"""
WITH p AS (SELECT page_id, {_PAGE_PATH} AS x FROM pages)
SELECT page_id, CASE WHEN trim(x) = '' THEN 'empty' WHEN ends_with(x, '/') THEN 'trailing_slash' WHEN starts_with(x, '/') OR regexp_matches(x, '^[A-Za-z]:') THEN 'absolute' WHEN regexp_matches(x, '(^|[/\\])\.\.([/\\]|$)') THEN 'traversal'
  WHEN NOT regexp_matches(x, '\.(json|md|js|txt|ya?ml)$') THEN 'extension' END AS problem FROM p""")
def component_paths(spark: SparkSession, sf: str) -> DataFrame:
    """F-15: why paths of components are refused."""
    return _t(spark, sf, "pages").select("page_id", ops.component_path_problem(_page_path()).alias("problem"))


_KIND_SQL = "CASE o_orderstatus WHEN 'F' THEN 'business_item' WHEN 'O' THEN 'company_knowledge' ELSE 'project' END"


def _order_kind() -> F.Column:
    return F.when(F.col("o_orderstatus") == "F", "business_item").when(F.col("o_orderstatus") == "O", "company_knowledge").otherwise("project")


@query(f"""
WITH o AS (SELECT o_orderkey, {_KIND_SQL} AS kind, 'K' || o_orderkey AS key, o_totalprice > 150000 AS active, o_orderpriority AS category, 'P/' || o_custkey AS project FROM orders)
SELECT o_orderkey, CASE WHEN active THEN '{writer.ACTIVE_ROOT}/' || replace(project, '/', '-') || '/' ELSE '{writer.BUSINESS_ROOT}/' END || category || '/' || CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_FOLDER.items())} END || '/' || key || '.md' AS path FROM o""")
def route_paths(spark: SparkSession, sf: str) -> DataFrame:
    """P-12: where records of orders go."""
    key, project = F.concat(F.lit("K"), F.col("o_orderkey").cast("string")), F.concat(F.lit("P/"), F.col("o_custkey").cast("string"))
    library = F.when(F.col("o_totalprice") > 150000, "active_tender").otherwise("business")
    return _t(spark, sf, "orders").select("o_orderkey", writer.route_path(_order_kind(), key, library, F.col("o_orderpriority"), project).alias("path"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN parts = '' THEN '来源原文' ELSE parts END AS place FROM (SELECT l_orderkey, l_linenumber, concat_ws('，', CASE WHEN l_returnflag = 'R' THEN '第 ' || l_partkey || ' 页' END, CASE WHEN l_returnflag = 'N' THEN '工作表“' || l_linestatus || '”' END,
  CASE WHEN l_linestatus = 'F' THEN '区域 A' || l_linenumber END, CASE WHEN l_linenumber > 2 THEN '第 ' || l_linenumber || ' 行' END, CASE WHEN l_returnflag = 'A' THEN '章节 ' || l_linestatus || ' / ' || l_linestatus END,
  CASE WHEN l_returnflag = 'A' AND l_linestatus <> 'F' THEN 'v' || l_suppkey END) AS parts FROM lineitem)""")
def human_places(spark: SparkSession, sf: str) -> DataFrame:
    """P-13: places of line items in words."""
    flag, none = F.col("l_returnflag"), F.lit(None).cast("string")
    place = F.struct(
        F.when(flag == "R", F.col("l_partkey")).alias("page"), F.when(flag == "N", F.col("l_linestatus")).alias("sheet"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("A"), F.col("l_linenumber").cast("string"))).alias("range"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("row"), none.alias("message_id"), F.when(flag == "A", F.array("l_linestatus", "l_linestatus")).alias("heading_path"), F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("value"),
    )
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", writer.human_locator(place).alias("place"))


@query("""
WITH l AS (SELECT o_orderkey, [o_orderstatus || ' ', o_orderpriority, '', o_orderstatus, NULL, o_orderpriority] AS v FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(v, lambda x: trim(x)), lambda x: x <> ''))), '|') AS sorted, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') AS first
FROM (SELECT *, list_filter(v, lambda x: x IS NOT NULL AND x <> '') AS w FROM l)""")
def unique_values(spark: SparkSession, sf: str) -> DataFrame:
    """U-03, Y-01: distinct values, sorted or in order of appearance."""
    v = F.array(F.concat("o_orderstatus", F.lit(" ")), "o_orderpriority", F.lit(""), "o_orderstatus", F.lit(None).cast("string"), "o_orderpriority")
    return _t(spark, sf, "orders").select("o_orderkey", F.array_join(text.unique_sorted(v), "|").alias("sorted"), F.array_join(text.unique_first(v), "|").alias("first"))


@query("""SELECT doc_id, 'evd-' || left(sha256(source || '␟' || doc_id || '␟' || coalesce(lang, '')), 24) AS id, '{"lang":"' || lang || '","source":"' || source || '"}' AS json, sha256('salt' || source) AS pseudonym, substring(text, 11, 25) AS cut FROM documents""")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    """C-08, J5-01, X-08, X-40, X-16: content-addressed ids, JSON with sorted keys, pseudonyms, cuts."""
    docs = _t(spark, sf, "documents")
    json = text.stable_json(source=text.json_text(F.col("source")), lang=text.json_text(F.col("lang")))
    return docs.select("doc_id", text.stable_id("evd", F.col("source"), F.col("doc_id").cast("string"), F.col("lang")).alias("id"), json.alias("json"), text.pseudonym(F.col("source"), "salt").alias("pseudonym"), text.safe_slice(F.col("text"), 10, 25).alias("cut"))


@query(rf"""
SELECT page_id, CASE WHEN k = '' THEN 'attachment' ELSE left(k, 180) END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*[\\/]', ''), {_CONTROL}), '[:*?"<>|]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS k FROM pages)""")
def attachment_names(spark: SparkSession, sf: str) -> DataFrame:
    """X-14: urls as names of attachments."""
    return _t(spark, sf, "pages").select("page_id", text.attachment_name(F.col("url")).alias("name"))


@query(r"""
SELECT page_id, 'legacy:' || CASE WHEN s = '' THEN CAST(page_id AS VARCHAR) ELSE s END AS id FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._:-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""")
def legacy_ids(spark: SparkSession, sf: str) -> DataFrame:
    """P-15."""
    return _t(spark, sf, "pages").select("page_id", text.legacy_id("legacy", F.col("url"), F.col("page_id")).alias("id"))


@query("SELECT c_custkey, c_name AS record_id, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS owner FROM customer")
def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    """X-39: values read back from front matter."""
    owner = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("owner: '"), "c_mktsegment", F.lit("'\n"))).otherwise("")
    content = F.concat(F.lit('---\nrecord_id: "'), "c_name", F.lit('"\n'), owner, F.lit("---\nbody record_id: x\n"))
    return _t(spark, sf, "customer").select("c_custkey", text.front_value(content, "record_id").alias("record_id"), text.front_value(content, "owner").alias("owner"))


@query("""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', CAST(floor((epoch_us(ts) % 1000000) / 1000) AS INTEGER)) || 'Z' AS instant FROM events""")
def local_times(spark: SparkSession, sf: str) -> DataFrame:
    """D-02: instants in a zone, and as precise ISO instants."""
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return _t(spark, sf, "events").select("event_id", numbers.local_date_time(at, "Asia/Shanghai").alias("local"), numbers.iso_instant(at).alias("instant"))


@query("""
WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'yyyy-mm-dd' WHEN 1 THEN '0.00' WHEN 2 THEN '"day" 0' WHEN 3 THEN '#,##0' ELSE 'builtin-date' END AS code, epoch_us(ts) AS t FROM events)
SELECT event_id, event_id % 5 IN (0, 4) AS is_date FROM c""")
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    """D-04."""
    k = F.col("event_id") % 5
    code = F.when(k == 0, "yyyy-mm-dd").when(k == 1, "0.00").when(k == 2, '"day" 0').when(k == 3, "#,##0").otherwise("builtin-date")
    return _t(spark, sf, "events").select("event_id", numbers.is_date_format(code).alias("is_date"))


@query("""
SELECT l_orderkey, l_linenumber, least(greatest(CAST(l_quantity AS DOUBLE), 10), 40) AS clamped, CAST(least(greatest(floor(CAST(l_extendedprice AS DOUBLE) + 0.5), 1), 30000) AS BIGINT) AS whole, CAST(7 AS DOUBLE) AS fallback,
  round(CAST(l_extendedprice AS DOUBLE) - 360 * floor(CAST(l_extendedprice AS DOUBLE) / 360), 4) AS turned, CAST(least(1000 * pow(2, l_linenumber - 1), 60000) AS BIGINT) AS backoff, CAST(CAST(l_quantity AS DOUBLE) * 1000 AS BIGINT) AS wait FROM lineitem""")
def number_rules(spark: SparkSession, sf: str) -> DataFrame:
    """N-01, N-03, N-06: clamps, rotations, waits."""
    rows = _t(spark, sf, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", numbers.clamp(F.col("l_quantity").cast("string"), 10, 40, 7).alias("clamped"), numbers.clamp_int(F.col("l_extendedprice").cast("string"), 1, 30000, 0).alias("whole"), numbers.clamp(F.col("l_linestatus"), 0, 1, 7).alias("fallback"),
        F.round(numbers.rotation(F.col("l_extendedprice")), 4).alias("turned"), numbers.backoff_ms(F.col("l_linenumber").cast("int")).alias("backoff"), numbers.retry_after_ms(F.col("l_quantity").cast("string")).alias("wait"),
    )


@query("""
WITH n AS (SELECT p_partkey, CAST(p_partkey % 18278 + 1 AS BIGINT) AS n FROM part)
SELECT p_partkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
  ELSE chr(CAST(64 + (n - 27) // 676 AS INTEGER)) || chr(CAST(65 + ((n - 27) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) END AS letters, CAST(n AS INTEGER) AS number FROM n""")
def column_names(spark: SparkSession, sf: str) -> DataFrame:
    """N-04: part keys as spreadsheet columns, there and back."""
    letters = numbers.column_letters((F.col("p_partkey") % 18278 + 1).cast("long"))
    return _t(spark, sf, "part").select("p_partkey", letters.alias("letters"), numbers.column_number(letters).alias("number"))


@query(r"""
WITH s AS (SELECT doc_id, greatest(length(text), 1) AS n, len(regexp_extract_all(text, chr(65533))) AS r, len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) AS c,
  len(regexp_extract_all(text, '[\x{00c3}\x{00c2}][\x{0080}-\x{00bf}]|\x{00e2}\x{20ac}')) AS m, len(regexp_extract_all(text, '[\p{L}\p{N}\p{P}\p{Zs}\s\x0b]')) AS ok FROM documents)
SELECT doc_id, round(ok / n, 6) AS readable, n > 0 AND (r / n > 0.02 OR c / n > 0.03 OR m / n > 0.05 OR ok / n < 0.62) AS gibberish FROM s""")
def readability(spark: SparkSession, sf: str) -> DataFrame:
    """X-10."""
    t = F.col("text")
    return _t(spark, sf, "documents").select("doc_id", F.round(numbers.corrupt_shares(t)["readable"], 6).alias("readable"), numbers.looks_like_gibberish(t).alias("gibberish"))


_SCRIPTS = [(n, p.replace("Is", "")) for n, p in lang.DOMINANT]


@query(f"""
WITH c AS (SELECT doc_id, {", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in _SCRIPTS)} FROM documents),
u AS (SELECT doc_id, unnest([{", ".join(f"{{'name': '{n}', 'i': {i}, 'n': {n + (' + CASE WHEN ja > 0 THEN zh ELSE 0 END' if n == 'ja' else '')}}}" for i, (n, _) in enumerate(_SCRIPTS))}]) AS x FROM c)
SELECT doc_id, CASE WHEN max(x.n) > 0 THEN arg_max(x.name, x.n * 100 - x.i) ELSE 'unknown' END AS language FROM u GROUP BY doc_id""")
def dominant_languages(spark: SparkSession, sf: str) -> DataFrame:
    """X-15."""
    return _t(spark, sf, "documents").select("doc_id", lang.dominant_language(F.col("text")).alias("language"))


def _score_sql(kind: str) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches(text, {_q('(?i)' + p)}) AS INTEGER)" for p in lang.SIGNALS[kind]) + ")"


@query(f"SELECT doc_id, CASE WHEN {_score_sql('parameter')} = 2 THEN 'parameter' {' '.join(f'WHEN {_score_sql(k)} > 0 THEN {_q(k)}' for k in lang.SIGNALS)} ELSE 'fact' END AS kind, {' + '.join(_score_sql(k) for k in lang.SIGNALS)} AS total FROM documents")
def semantic_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """X-02, L-02, A-03: the dominant kind of each document, and the sum of its signals."""
    scored = F.transform(F.array(lang.semantic_signals(F.col("text"))), lambda s: F.struct(lang.kind_of(s).alias("kind"), sum((s[k] for k in lang.SIGNALS), F.lit(0)).alias("total")))
    return _t(spark, sf, "documents").select("doc_id", F.inline(scored))


_DATES = f"list_slice(regexp_extract_all(text, {_q(lang.DATE)}), 1, 10)"


@query(f"""
WITH d AS (SELECT doc_id, list_filter(list_transform({_DATES}, lambda v: left(trim(regexp_replace(v, {_CONTROL})), 160)), lambda v: v <> '') AS v FROM documents)
SELECT doc_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS dates FROM d""")
def date_facts(spark: SparkSession, sf: str) -> DataFrame:
    """D-03, X-04: dates in the texts."""
    return _t(spark, sf, "documents").select("doc_id", F.array_join(lang.extract_dates(F.col("text")), "|").alias("dates"))


def _facts_sql(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(text, {_q(pattern)}), lambda v: trim(regexp_replace(v, {_CONTROL})))"


@query(f"""
WITH d AS (SELECT doc_id, list_filter(list_concat({_facts_sql('(?i)' + lang.NUMBER)}, {_facts_sql(lang.DATE)}, {_facts_sql(lang.MODEL)}, {_facts_sql('(?i)' + lang.STANDARD)}, {_facts_sql(lang.NAME)}), lambda v: v <> '') AS v FROM documents)
SELECT doc_id, CAST(len(list_distinct(v)) AS INTEGER) AS n, sha256(array_to_string(list_sort(list_distinct(v)), '|')) AS hash FROM d""")
def protected_facts(spark: SparkSession, sf: str) -> DataFrame:
    """X-05: what a translation must keep."""
    tokens = lang.protected_tokens(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n"), text.digest(F.array_join(F.array_sort(tokens), "|")).alias("hash"))


def _rendered_sql() -> str:
    out = "text"
    for pattern, replacement in lang.RENDERINGS:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(replacement.replace('$', chr(92)))}, 'g')"
    return out


@query(f"SELECT doc_id, sha256(r) AS hash, r <> text AS changed FROM (SELECT doc_id, text, {_rendered_sql()} AS r FROM documents)")
def rendered_chinese(spark: SparkSession, sf: str) -> DataFrame:
    """X-06: ordered renderings."""
    out = lang.deterministic_chinese(F.col("text"))["text"]
    return _t(spark, sf, "documents").select("doc_id", text.digest(out).alias("hash"), (out != F.col("text")).alias("changed"))


@query("SELECT event_type AS code, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def error_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A-26."""
    return ops.errors_by_code(_t(spark, sf, "events").select(F.col("event_type").alias("code"), F.col("ts").alias("at")))


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS reviews FROM orders GROUP BY 1")
def status_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """A-19: orders as tasks with reviews."""
    reviews = F.when(F.col("o_totalprice") > 200000, F.array(F.lit("a"), F.lit("b"))).when(F.col("o_totalprice") > 100000, F.array(F.lit("a")))
    return ops.status_counts(_t(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), reviews.alias("review_ids")))


@query("""
WITH r AS (SELECT l_linestatus, avg(CAST(l_quantity AS DOUBLE)) AS q, avg(CAST(l_linenumber AS DOUBLE)) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_linestatus, avg(CAST(l_quantity AS DOUBLE)) AS q, avg(CAST(l_linenumber AS DOUBLE)) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT coalesce(r.l_linestatus, b.l_linestatus) AS l_linestatus, round(r.q, 6) AS run_q, round(b.q, 6) AS base_q, round(r.q - b.q, 6) AS delta_q, round(r.n - b.n, 6) AS delta_n FROM r FULL JOIN b ON r.l_linestatus = b.l_linestatus""")
def shadow_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """A-20: returned line items against the others."""
    rows = _t(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").cast("double").alias("q"), F.col("l_linenumber").cast("double").alias("n"))
    out = ops.shadow_delta(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), ["l_linestatus"], ["q", "n"])
    return out.select("l_linestatus", *(F.round(c, 6).alias(c) for c in ("run_q", "base_q", "delta_q", "delta_n")))


@query("""
SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 15 DAY) WHERE n <= 3""")
def retained_events(spark: SparkSession, sf: str) -> DataFrame:
    """W-11: the newest three events of a user, none over fifteen days old."""
    return ops.retained(_t(spark, sf, "events"), ["user_id"], "ts", "event_id", 3, 15, F.lit("2024-01-20 00:00:00").cast(_t(spark, sf, "events").schema["ts"].dataType)).select("event_id", "user_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderkey) END AS position, round(avg(o_orderkey % 101) OVER (PARTITION BY o_custkey), 6) AS run_percent FROM orders""")
def queue_positions(spark: SparkSession, sf: str) -> DataFrame:
    """W-12: open orders of a customer as waiting tasks."""
    tasks = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "waiting").otherwise("done").alias("status"), (F.col("o_orderkey") % 101).alias("percent"))
    return ops.queue_position(tasks, ["o_custkey"], ["o_orderkey"]).select("o_orderkey", F.col("position").cast("long").alias("position"), F.round("run_percent", 6).alias("run_percent"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def third_page(spark: SparkSession, sf: str) -> DataFrame:
    """L-07: the third page of the newest orders; fifty rows a page are the feature."""
    rows = _t(spark, sf, "orders").withColumn("age", F.datediff(F.lit("2100-01-01").cast("date"), F.col("o_orderdate").cast("date")))
    return ops.page(rows, ["age", "o_orderkey"], 2).select("o_orderkey", "o_custkey")


@query("""
WITH s AS (SELECT event_id, user_id, event_type, sum(length('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}') + 1) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS size FROM events) SELECT event_id, user_id FROM s WHERE size <= 998""")
def bounded_reports(spark: SparkSession, sf: str) -> DataFrame:
    """C-38: the newest events of each user whose JSON fits into a thousand bytes."""
    return ops.bounded_report(_t(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], 1000).select("event_id", "user_id")


@query("""
SELECT o_orderkey, o_orderstatus = 'O' AND o_totalprice > 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 3 <> 0 AS ok FROM orders""")
def approvals(spark: SparkSession, sf: str) -> DataFrame:
    """F-13: orders that may be approved together, and the others."""
    items = _t(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), (F.col("o_totalprice") > 50000).alias("has_evidence"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "matched").when(F.col("o_orderpriority") == "2-HIGH", "not_applicable").otherwise("conflict").alias("consistency"), F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("gate"))).otherwise(F.array().cast("array<string>")).alias("hard_gates"),
    )
    good, others = ops.approval_plan(items)
    return good.select("o_orderkey", F.lit(True).alias("ok")).unionByName(others.select("o_orderkey", F.lit(False).alias("ok")))


@query("""
WITH o AS (SELECT o_orderkey, (o_orderkey % 11) / 10.0 AS a, (o_custkey % 6) / 5.0 AS b, o_orderstatus = 'P' AS hard, o_totalprice > 300000 AS costly FROM orders)
SELECT o_orderkey, round(a * 0.75 + b * 0.25, 6) AS score, CASE WHEN NOT hard AND a * 0.75 + b * 0.25 >= 0.9 THEN 'auto_ingest' ELSE 'review' END AS decision, concat_ws('|', CASE WHEN hard THEN 'partial' END, CASE WHEN costly THEN 'costly' END) AS failed, CASE WHEN hard OR costly THEN 'review' ELSE 'pass' END AS report FROM o""")
def confidence_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A-16, A-17: weighted components with a hard rule, and the report of hard gates."""
    rows = _t(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") % 11) / 10).alias("a"), ((F.col("o_custkey") % 6) / 5).alias("b"), (F.col("o_orderstatus") == "P").alias("hard"), (F.col("o_totalprice") > 300000).alias("costly"))
    score, report = ops.confidence({"a": 3.0, "b": 1.0}, [F.col("hard")]), ops.validation_report({"partial": F.col("hard"), "costly": F.col("costly")})
    return rows.select("o_orderkey", score["score"].alias("score"), score["decision"].alias("decision"), F.array_join(report["failed"], "|").alias("failed"), report["decision"].alias("report"))


@query("SELECT doc_id, CAST(1500 AS BIGINT) AS ms, CAST(ceil(length(text) / 3.0) AS BIGINT) AS estimated_tokens, left(sha256(text), 12) AS hash FROM documents")
def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """P-18."""
    at = lambda s: F.lit(s).cast("timestamp")
    return _t(spark, sf, "documents").select("doc_id", ops.stage_metric(at("2024-01-01 00:00:00"), at("2024-01-01 00:00:01.5"), F.col("text")).alias("m")).select("doc_id", "m.ms", "m.estimated_tokens", "m.hash")


_DONE = "SELECT l_orderkey * 10 + l_linenumber AS key FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F'"


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_returnflag", "l_linestatus")
    done = rows.where("l_linestatus = 'F'").select("key", F.when(F.col("l_returnflag") == "R", "failed").alias("error"))
    return rows.select("l_orderkey", "key"), done


@query(f"SELECT key FROM (SELECT l_orderkey * 10 + l_linenumber AS key FROM lineitem) WHERE key NOT IN ({_DONE})")
def resumed(spark: SparkSession, sf: str) -> DataFrame:
    """T-07: line items without a good result run again."""
    rows, done = _batches(spark, sf)
    return ops.pending(rows, done, "key").select("key")


@query(f"SELECT l_orderkey, bool_and(l_orderkey * 10 + l_linenumber IN ({_DONE})) AS complete FROM lineitem GROUP BY 1")
def completed(spark: SparkSession, sf: str) -> DataFrame:
    """T-08: orders all of whose lines have a good result."""
    rows, done = _batches(spark, sf)
    return ops.complete(rows, done, "l_orderkey", "key").select("l_orderkey", "complete")


_ATOMS = "SELECT l_orderkey AS card_id, l_partkey AS point_id FROM lineitem"


@query(f"""
WITH a AS ({_ATOMS}), s AS (SELECT o_orderkey AS card_id FROM orders WHERE o_custkey % 2 = 0), mine AS (SELECT * FROM a SEMI JOIN s USING (card_id)), shared AS (SELECT DISTINCT point_id FROM a ANTI JOIN s USING (card_id)),
refused AS (SELECT DISTINCT card_id FROM mine WHERE point_id IN (SELECT point_id FROM shared) UNION SELECT card_id FROM s ANTI JOIN a USING (card_id))
SELECT 'refused' AS what, card_id AS id FROM refused UNION ALL SELECT DISTINCT 'point', point_id FROM mine ANTI JOIN refused USING (card_id)""")
def regenerated(spark: SparkSession, sf: str) -> DataFrame:
    """X-47: points to make again, and cards refused because others share their points."""
    selected = _t(spark, sf, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("card_id"))
    atoms = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("card_id"), F.array("l_partkey").alias("point_ids"))
    points, refused = ops.regeneration_plan(selected, atoms)
    return refused.select(F.lit("refused").alias("what"), F.col("card_id").alias("id")).unionByName(points.select(F.lit("point").alias("what"), F.col("point_id").alias("id")))


@query("""
WITH n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, id) AS id, CASE WHEN id IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'extra' ELSE 'duplicate' END AS problem FROM (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) c FULL JOIN n ON c_custkey = id WHERE id IS NULL OR c_custkey IS NULL OR n > 1""")
def response_ids(spark: SparkSession, sf: str) -> DataFrame:
    """O-04, J-17: asked customers against the answers, orders: missing, extra and duplicate ids."""
    return ops.id_sets_match(_t(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id")), _t(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("""
SELECT o_orderkey, 'always' || chr(10) || o_orderpriority || CASE WHEN o_orderstatus <> o_orderpriority THEN chr(10) || o_orderstatus ELSE '' END AS prompt FROM orders""")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """X-38: rules once each."""
    parts = F.array("o_orderpriority", F.lit("always"), F.lit(" "), "o_orderstatus", "o_orderpriority")
    return _t(spark, sf, "orders").select("o_orderkey", ops.compose_prompt(parts, F.array(F.lit("always"))).alias("prompt"))


@query("""
WITH c AS (SELECT r_name AS library, c_mktsegment AS category, string_agg('- [[' || printf('%08d', c_custkey) || '|' || c_name || ']]', chr(10) ORDER BY printf('%08d', c_custkey)) AS body FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT library, sha256(string_agg('## ' || category || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY category)) AS page FROM c GROUP BY library""")
def index_pages(spark: SparkSession, sf: str) -> DataFrame:
    """S-33: an index page of each region's customers by segment."""
    rows = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("library"), F.col("c_mktsegment").alias("category"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("record_id"), F.col("c_name").alias("title"))
    return ops.index_page(rows).select("library", F.sha2("markdown", 256).alias("page"))


@query("""
WITH e AS (SELECT l_orderkey, l_suppkey, unnest([l_linestatus, l_returnflag]) AS entity FROM lineitem)
SELECT entity, count(DISTINCT l_orderkey) AS cards, count(DISTINCT l_suppkey) AS projects FROM e GROUP BY 1""")
def entities(spark: SparkSession, sf: str) -> DataFrame:
    """A-21: ship modes and flags with their orders and suppliers."""
    cards = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("card_id"), F.col("l_suppkey").alias("project"), F.array("l_linestatus", "l_returnflag").alias("entities"))
    return ops.entity_rollup(cards).select("entity", F.size("cards").cast("long").alias("cards"), F.size("projects").cast("long").alias("projects"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 4 {' '.join(f'WHEN {i} THEN {_q(ops.ISSUES[k])}' for i, k in enumerate(list(ops.ISSUES)[3:6]))} ELSE 'other' END AS category FROM orders")
def issue_categories(spark: SparkSession, sf: str) -> DataFrame:
    """X-50."""
    k = F.col("o_orderkey") % 4
    a, b, c = list(ops.ISSUES)[3:6]
    return _t(spark, sf, "orders").select("o_orderkey", ops.explain_issue(F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise("unheard of")).alias("category"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'builtin' END AS VARCHAR) AS origin, json_valid(CASE WHEN event_id % 3 = 0 THEN left(props, 9) ELSE props END) AS valid FROM events")
def component_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """C-35: a user's file wins, also an invalid one."""
    rows = _t(spark, sf, "events")
    user = rows.where("event_id % 3 = 0").select("event_id", F.substring("props", 1, 9).alias("content"))
    return ops.contracts(user, rows.select("event_id", F.col("props").alias("content")), "event_id").select("event_id", "origin", "valid")


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'explicit:' || o_custkey WHEN o_custkey % 2 = 0 THEN 'ingestion:' || o_custkey WHEN o_custkey % 3 = 0 THEN 'provider:' || o_orderpriority ELSE 'initial-hash:' || o_orderkey END AS identity,
  '{KIND_PREFIX["business_item"]}-' || left(sha256('o' || o_orderkey), 24) AS record_id FROM orders""")
def source_identities(spark: SparkSession, sf: str) -> DataFrame:
    """C-12: the ladder of identities, and ids of records."""
    s = lambda c: F.col(c).cast("string")
    found = writer.source_identity(F.when(F.col("o_orderstatus") == "F", s("o_custkey")), F.when(F.col("o_custkey") % 2 == 0, s("o_custkey")), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")), s("o_orderkey"))
    return _t(spark, sf, "orders").select("o_orderkey", found.alias("identity"), writer.record_id("business_item", F.concat(F.lit("o"), s("o_orderkey"))).alias("record_id"))


@query("SELECT o_orderkey AS candidate_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')")
def approved(spark: SparkSession, sf: str) -> DataFrame:
    """J-03: candidates with a decision that isn't mandatory handling."""
    decisions = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.when(F.col("l_returnflag") == "R", "mandatory_human_handling").otherwise("auto").alias("outcome"))
    return writer.approved_items(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("candidate_id")), decisions)


@query("""
WITH u AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_returnflag = 'N' ELSE false END) AS active, count(DISTINCT CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey END) AS projects FROM lineitem GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS source_document_id, active, projects, NOT active OR projects = 1 AS ok FROM u""")
def registered_projects(spark: SparkSession, sf: str) -> DataFrame:
    """J-11: units of the active library against registered projects."""
    library = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "N"), "active_tender").otherwise("business")
    units = _t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_document_id"), F.struct(library.alias("library")).alias("route"), F.array(F.col("l_suppkey").cast("string")).alias("project_ids"))
    registry = _t(spark, sf, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").cast("string").alias("project_id"))
    return writer.registry_unique(units, registry)


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'R' || (p_partkey // 2) END AS id, 'dir/' || printf('%08d', p_partkey) || '.md' AS path FROM part)
SELECT id AS record_id, string_agg(path, '|' ORDER BY path) AS paths FROM p WHERE id <> '' GROUP BY id HAVING count(*) > 1""")
def same_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A-10: ids that files at several paths carry."""
    key = F.col("p_partkey")
    line = F.when(key % 5 == 0, "title: x").otherwise(F.concat(F.lit("record_id: R"), F.floor(key / 2).cast("string")))
    files = _t(spark, sf, "part").select(F.concat(F.lit("dir/"), F.lpad(key.cast("string"), 8, "0"), F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), line, F.lit("\n---\n")).alias("content"))
    return writer.physical_duplicates(files).select("record_id", F.array_join("paths", "|").alias("paths"))


@query("SELECT c_custkey AS from_id, c_nationkey + 1000000 AS to_id, 'in' AS type FROM customer UNION SELECT c_nationkey + 1000000, c_custkey, 'in' FROM customer")
def reverse_relations(spark: SparkSession, sf: str) -> DataFrame:
    """J-21: relations in both directions."""
    return writer.two_way(_t(spark, sf, "customer").select(F.col("c_custkey").alias("from_id"), (F.col("c_nationkey") + 1000000).cast("long").alias("to_id"), F.lit("in").alias("type"))).select(F.col("from_id").cast("long").alias("from_id"), F.col("to_id").cast("long").alias("to_id"), "type")


@query("SELECT c_custkey, '[[' || c_custkey || '|' || CASE WHEN c_acctbal > 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END || ']]' AS link FROM customer")
def wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    """C-19."""
    return _t(spark, sf, "customer").select("c_custkey", writer.relation_link(F.col("c_custkey").cast("string"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("")).alias("link"))


@query("""
WITH p AS (SELECT doc_id, string_split(text, ' the ') AS p FROM documents), u AS (SELECT doc_id, i AS nth, CAST(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + (i - 1) * 5 AS INTEGER) AS start FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM p))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(max(nth) AS BIGINT) AS last, CAST(sum(start) AS BIGINT) AS places FROM u GROUP BY doc_id""")
def quote_places(spark: SparkSession, sf: str) -> DataFrame:
    """W-13: all places of a repeated quote."""
    found = provenance.occurrences(_t(spark, sf, "documents").select("doc_id", "text", F.lit(" the ").alias("quote")), ["doc_id"], "text", "quote")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("nth").cast("long").alias("last"), F.sum("start").alias("places"))


def _has(pattern: str) -> str:
    return f"regexp_matches(text, {_q('(?i)' + pattern)})"


@query(f"SELECT doc_id, CASE WHEN {_has(provenance.MUST_NOT)} THEN 'must_not' WHEN {_has(provenance.MUST)} THEN 'must' WHEN {_has(provenance.SHOULD)} THEN 'should' WHEN {_has(provenance.MAY)} THEN 'may' ELSE 'none' END AS modality FROM documents")
def modalities(spark: SparkSession, sf: str) -> DataFrame:
    """X-30, modality of claims."""
    return _t(spark, sf, "documents").select("doc_id", provenance.modality(F.col("text")).alias("modality"))


@query("""
WITH a AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN left(text, 20) ELSE 'not there: ' || item_id END AS quote, text FROM benchmark)
SELECT item_id, sha256(CASE WHEN contains(text, quote) THEN text ELSE quote END) AS evidence, contains(text, quote) AS verified FROM a""")
def expanded_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """X-42, F-04: quotes become the whole text of their block, if it holds them."""
    rows = _t(spark, sf, "benchmark").select("item_id", F.col("item_id").alias("source_document_id"), F.lit("b").alias("block_id"), "text")
    quote = F.when(F.col("item_id") % 2 == 0, F.substring("text", 1, 20)).otherwise(F.concat(F.lit("not there: "), F.col("item_id").cast("string")))
    out = provenance.expand_evidence(rows.select("item_id", "source_document_id", "block_id", quote.alias("quote")), rows.select("source_document_id", "block_id", "text"))
    return out.select("item_id", F.sha2("evidence", 256).alias("evidence"), "verified")


@query("""
WITH a AS (SELECT o_custkey AS doc, o_orderkey AS atom_id, unnest(CASE WHEN o_orderstatus = 'P' THEN [NULL::BIGINT] ELSE [o_orderkey, o_orderkey + 1000000000] END) AS point_id FROM orders),
p AS (SELECT l_orderkey AS point_id, l_partkey AS evidence_id FROM lineitem WHERE l_linenumber < 3),
r AS (SELECT a.*, coalesce(p.evidence_id % 5 <> 0, false) AS held, p.point_id IS NOT NULL AS known FROM a LEFT JOIN p ON a.point_id = p.point_id)
SELECT CASE WHEN point_id IS NULL THEN 'no_attribution' WHEN NOT known THEN 'unknown_point' WHEN NOT held THEN 'missing_evidence' ELSE 'linked' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def attributed_points(spark: SparkSession, sf: str) -> DataFrame:
    """J-23: atoms, points and evidence, many to many, with counts of what is dropped."""
    orders, items = _t(spark, sf, "orders"), _t(spark, sf, "lineitem").where("l_linenumber < 3")
    key = F.col("o_orderkey").cast("long")
    ids = F.when(F.col("o_orderstatus") != "P", F.array(key, key + 1000000000))
    atoms = orders.select(F.lit(1).alias("source_document_id"), F.col("o_orderkey").alias("atom_id"), ids.alias("point_ids"))
    points = items.groupBy(F.col("l_orderkey").cast("long").alias("point_id")).agg(F.collect_list("l_partkey").alias("evidence_ids")).withColumn("source_document_id", F.lit(1))
    evidence = items.where("l_partkey % 5 <> 0").select(F.col("l_partkey").alias("evidence_id"), F.lit(1).alias("source_document_id")).distinct()
    links, dropped = provenance.point_atoms(atoms, points, evidence)
    return links.select(F.lit("linked").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n")).unionByName(dropped.select(F.col("dropped").alias("outcome"), "n"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def debounced_writes(spark: SparkSession, sf: str) -> DataFrame:
    """T-03: the last event of each user in each hour."""
    rows = _t(spark, sf, "events").withColumn("at", F.col("ts"))
    return E.debounced(rows.select("event_id", "user_id", "at"), "user_id", "at", "1 hour").select("event_id", "user_id")


@query("SELECT l_orderkey, arg_min(l_suppkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1")
def lease_owners(spark: SparkSession, sf: str) -> DataFrame:
    """T-05: the first claim of a lease wins."""
    return E.owners(_t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_suppkey")


_STATES = tuple(PRODUCTION)


@query(f"""
WITH s AS (SELECT event_id, user_id, ts, [{", ".join(_q(s) for s in _STATES)}][1 + event_id % {len(_STATES)}] AS state FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM s)
SELECT event_id, previous, previous IS NULL OR previous = state {" ".join(f"OR (previous = {_q(a)} AND state IN ({', '.join(_q(x) for x in b)}))" for a, b in PRODUCTION.items() if b)} AS legal FROM l""")
def production_states(spark: SparkSession, sf: str) -> DataFrame:
    """T-06: each user's states in turn against the fixed table."""
    state = F.element_at(F.array(*(F.lit(s) for s in _STATES)), (F.col("event_id") % len(_STATES) + 1).cast("int"))
    rows = _t(spark, sf, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), state.alias("state"))
    return E.with_transitions(rows, "user_id", "at", "state").select("event_id", "previous", "legal")


@query("""
WITH e AS (SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS done FROM events GROUP BY 1)
SELECT event_id, coalesce((event_type = 'purchase' AND ts = done) OR done IS NULL OR ts < done, false) AS accepted FROM events JOIN e USING (user_id)""")
def late_progress(spark: SparkSession, sf: str) -> DataFrame:
    """T-04: progress after a user's first purchase is late."""
    return E.late_progress(_t(spark, sf, "events"), "user_id", "ts", "event_type", ("purchase",)).select("event_id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


_CELLS = "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS \"row\", CAST(l_suppkey % 4 AS INTEGER) AS col, CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_partkey % 7 = 0 THEN 'n/a' ELSE 'v' || (l_partkey % 50) END AS value, l_partkey % 2 = 0 AS merged, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey % 4 ORDER BY l_partkey, l_suppkey) AS n FROM lineitem"
_FULL = "value <> '' AND NOT regexp_matches(value, '(?i)^(?:[-—/\\\\]|n/?a|无|合计|小计|序号)$')"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as cells of their order's table, one for each place."""
    from pyspark.sql import Window as W

    value = F.when(F.col("l_partkey") % 3 == 0, "").when(F.col("l_partkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit("v"), (F.col("l_partkey") % 50).cast("string")))
    rows = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("row"), (F.col("l_suppkey") % 4).cast("int").alias("col"), value.alias("value"), (F.col("l_partkey") % 2 == 0).alias("merged"), "l_partkey", "l_suppkey")
    first = F.row_number().over(W.partitionBy("l_orderkey", "row", "col").orderBy("l_partkey", "l_suppkey"))
    return rows.withColumns({"n": first, "ord": F.lit(0)}).where("n = 1").drop("n", "l_partkey", "l_suppkey")


@query(f"""
WITH c AS (SELECT * FROM ({_CELLS}) WHERE n = 1), f AS (SELECT l_orderkey, "row" AS r, col AS c, value AS v FROM c WHERE {_FULL}),
b AS (SELECT c.l_orderkey, c."row", c.col, arg_max(f.v, f.r * 10 + f.c) AS filled FROM c JOIN f ON c.l_orderkey = f.l_orderkey AND f.r <= c."row" AND f.c <= c.col WHERE merged AND NOT ({_FULL}) GROUP BY ALL)
SELECT c.l_orderkey, c."row", c.col, CASE WHEN {_FULL} THEN value ELSE coalesce(filled, '') END AS value FROM c LEFT JOIN b ON c.l_orderkey = b.l_orderkey AND c."row" = b."row" AND c.col = b.col""")
def merged_cells(spark: SparkSession, sf: str) -> DataFrame:
    """J-15, F-09: blank cells of merges take the last meaningful one above or before them."""
    return tables.fill_merged(_cells(spark, sf), ["l_orderkey"]).select("l_orderkey", "row", "col", "value")


@query(f"""
WITH c AS (SELECT * FROM ({_CELLS}) WHERE n = 1), f AS (SELECT l_orderkey, "row", arg_min(value, col) AS label FROM c WHERE value <> '' GROUP BY 1, 2)
SELECT l_orderkey, "row", label FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, label) AS n FROM f WHERE NOT regexp_matches(label, '^-?\\d+(\\.\\d+)?$')) WHERE n = 1""")
def row_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A-13: labels that stand in one row of their table only."""
    return tables.unique_row_labels(_cells(spark, sf), ["l_orderkey"]).select("l_orderkey", "row", "label")


@query("""
WITH r AS (SELECT s_suppkey, 1 + s_suppkey % 3 AS c1, 1 + s_suppkey % 5 AS r1, 1 + s_suppkey % 3 + s_suppkey % 2 AS c2, 1 + s_suppkey % 5 + s_suppkey % 4 AS r2 FROM supplier),
x AS (SELECT *, unnest(range(r1, r2 + 1)) AS "row" FROM r) SELECT s_suppkey, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, "row" = r1 AND col = c1 AS anchor FROM (SELECT *, unnest(range(c1, c2 + 1)) AS col FROM x)""")
def merge_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """J-13: the cells of merges."""
    k = F.col("s_suppkey")
    cell = lambda col, row: F.concat(F.char(64 + col), row.cast("string"))
    c1, r1 = 1 + k % 3, 1 + k % 5
    rows = _t(spark, sf, "supplier").select("s_suppkey", F.concat(cell(c1, r1), F.lit(":"), cell(c1 + k % 2, r1 + k % 4)).alias("range"))
    return tables.expand_ranges(rows).select("s_suppkey", "row", "col", "anchor")


@query("""
WITH p AS (SELECT c_custkey, lower(c_mktsegment) AS content FROM customer) SELECT c_custkey, c_mktsegment AS content FROM customer WHERE NOT (c_custkey % 2 = 0)""")
def fresh_points(spark: SparkSession, sf: str) -> DataFrame:
    """O-03: points that a document's summary doesn't have yet, whatever their case and white space."""
    points = _t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("content"))
    there = points.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit(" "), F.lower("content"), F.lit("\n")).alias("content"))
    return tables.new_points(points, there, ["c_custkey"]).select("c_custkey", "content")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber AS chunk_no, (l_linenumber - 1) * 100 + CASE WHEN l_partkey % 40 = 0 THEN 60 ELSE 0 END AS s, l_linenumber * 100 + 20 AS e FROM lineitem),
w AS (SELECT *, lag(s) OVER (PARTITION BY l_orderkey ORDER BY chunk_no, s) AS b, lag(e) OVER (PARTITION BY l_orderkey ORDER BY chunk_no, s) AS le FROM c)
SELECT l_orderkey, bool_and(coalesce(CASE WHEN b IS NULL THEN s = 0 ELSE s > b AND s <= le END, false)) AS valid FROM w GROUP BY 1""")
def chunk_order(spark: SparkSession, sf: str) -> DataFrame:
    """X-20: chunks whose starts ascend without a gap; equal numbers stand in order of their starts."""
    rows = _t(spark, sf, "lineitem")
    start = (F.col("l_linenumber") - 1) * 100 + F.when(F.col("l_partkey") % 40 == 0, 60).otherwise(0)
    chunks = rows.select("l_orderkey", F.struct(F.col("l_linenumber"), start.alias("s")).alias("chunk_no"), start.alias("start"), (F.col("l_linenumber") * 100 + 20).alias("end"))
    return split.validate_chunks(chunks, "l_orderkey")


@query("""
WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '# T' || turn WHEN turn % 3 = 1 THEN '## U' || turn ELSE 'body' END AS t FROM conversations),
w AS (SELECT *, max(CASE WHEN turn % 3 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS h1, max(CASE WHEN turn % 3 = 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS h2 FROM l)
SELECT conv_id, turn, concat_ws(' > ', CASE WHEN h1 IS NOT NULL THEN 'T' || h1 END, CASE WHEN h2 IS NOT NULL AND (h1 IS NULL OR h2 > h1) THEN 'U' || h2 END) AS breadcrumb FROM w""")
def headings_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """W-14: the headings in force at each turn."""
    k = F.col("turn") % 3
    said = F.when(k == 0, F.concat(F.lit("# T"), F.col("turn").cast("string"))).when(k == 1, F.concat(F.lit("## U"), F.col("turn").cast("string"))).otherwise("body")
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", said.alias("text"))
    return split.breadcrumbs(rows, "conv_id", "turn").select("conv_id", "turn", "breadcrumb")


@query("""SELECT item_id, item_id % 3 <> 0 AND trim(text) <> '' AS full, item_id % 2 = 0 AS inside FROM benchmark""")
def verifiable_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """F-03, F-04: evidence with a quote, a block and a place; quotes within their block."""
    quote = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("  "), F.substring("text", 3, 30))).otherwise("no such quote")
    full = gate.verifiable(F.col("text"), F.lit("b"), F.lit("block"), F.when(F.col("item_id") % 3 != 0, "p1"))
    return _t(spark, sf, "benchmark").select("item_id", full.alias("full"), candidates.evidence_within(quote, F.col("text")).alias("inside"))


@query("""
WITH g AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS hard, CASE WHEN o_custkey % 3 = 0 THEN 'accept' WHEN o_custkey % 3 = 1 THEN 'reject' END AS decision FROM orders)
SELECT o_orderkey AS group_id, CASE WHEN decision IS NULL THEN 'open' WHEN hard AND decision = 'accept' THEN 'rejected_approval' ELSE decision END AS result FROM g""")
def reviewed_groups(spark: SparkSession, sf: str) -> DataFrame:
    """C-33: reviewers' decisions; hard conflicts can't be approved."""
    orders = _t(spark, sf, "orders")
    groups = orders.select(F.col("o_orderkey").alias("group_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical_fact_conflict").otherwise("missing_evidence").alias("root_cause"))
    decisions = orders.where("o_custkey % 3 < 2").select(F.col("o_orderkey").alias("group_id"), F.when(F.col("o_custkey") % 3 == 0, "accept").otherwise("reject").alias("decision"))
    return gate.group_actions(groups, decisions).select("group_id", "result")


@query("""
SELECT 'left' AS side, value FROM (SELECT DISTINCT c_custkey AS value FROM customer WHERE c_custkey % 5 <> 0 EXCEPT SELECT o_custkey FROM orders) UNION ALL
SELECT 'right', value FROM (SELECT DISTINCT o_custkey AS value FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)""")
def visible_paths(spark: SparkSession, sf: str) -> DataFrame:
    """O-05: what was planned against what is visible, with differences on both sides."""
    return commit.set_difference(_t(spark, sf, "customer").where("c_custkey % 5 <> 0").select("c_custkey"), _t(spark, sf, "orders").select("o_custkey"))


@query(r"""
WITH f AS (SELECT p_partkey, 'kb/' || p_partkey || '.md' AS path, 'record_id: r' || p_partkey || chr(10) || 'record_kind: project' || chr(10) AS content FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'missing_file' WHEN p_partkey % 5 = 1 THEN 'empty_file' WHEN p_partkey % 5 = 2 THEN 'identity_or_source_mismatch' WHEN p_partkey % 5 = 3 THEN 'hash_mismatch' END AS reason,
  CASE WHEN p_partkey % 2 = 0 THEN 'unchanged' ELSE 'create' END AS disposition, CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 1 ELSE length(content) END AS INTEGER) AS bytes FROM f""")
def read_back(spark: SparkSession, sf: str) -> DataFrame:
    """C-18, C-20: what reading back shows: missing, empty, of another record, changed, or as planned."""
    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    rows = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("kb/"), key, F.lit(".md")).alias("path"), F.concat(F.lit("record_id: r"), key, F.lit("\nrecord_kind: project\n")).alias("content"))
    actions = rows.select(
        "p_partkey", "path", F.concat(F.lit("r"), F.when(k == 2, "x").otherwise(key)).alias("record_id"), F.lit("project").alias("record_kind"), F.lit(None).cast("string").alias("owner_source_id"),
        F.when(F.col("p_partkey") % 2 == 0, "noop").otherwise("create").alias("action"), F.sha2(F.when(k == 3, "other").otherwise(F.col("content")), 256).alias("content_hash"),
    )
    files = rows.where(k != 0).select("path", F.when(k == 1, " ").otherwise(F.col("content")).alias("content"))
    return commit.verify(actions, files).select("p_partkey", "reason", "disposition", F.col("bytes").cast("int").alias("bytes"))


@query("""
WITH r AS (SELECT l_orderkey AS task_id, 'kb/' || l_partkey % 40 || '.md' AS path FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'N' AND l_linenumber <> 3)
SELECT task_id, count(DISTINCT path) AS verified, sha256(string_agg(DISTINCT path, '|' ORDER BY path)) AS paths FROM r GROUP BY 1""")
def verified_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """A-24, F-07, F-08: distinct final paths of the verified records of a task's own run."""
    key = F.col("l_orderkey").cast("string")
    rows = _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("nth"), F.when(F.col("l_linestatus") == "F", "visible_verified").otherwise("planned").alias("state"), F.lit("r").alias("record_id"),
        F.lit(commit.KNOWLEDGE_KINDS[0]).alias("record_kind"), F.concat(F.lit("/kb\\"), (F.col("l_partkey") % 40).cast("string"), F.lit(".md/")).alias("final_path"), F.when(F.col("l_returnflag") == "N", "other").otherwise(key).alias("run_id"), key.alias("task_run_id"),
        F.lit("markdown").alias("vault_file_type"), F.lit("business").alias("target_library"), F.when(F.col("l_linenumber") == 3, "none").otherwise(F.sha2(key, 256)).alias("content_hash"), F.lit("t").alias("transaction_id"),
    )
    return commit.verified_facts(rows).select("task_id", "verified", F.sha2(F.array_join("paths", "|"), 256).alias("paths"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AS hit FROM orders")
def checkpointed(spark: SparkSession, sf: str) -> DataFrame:
    """S-31, U-10: stored stages; corrupt artifacts are misses."""
    orders = _t(spark, sf, "orders").select("o_orderkey", F.lit("split").alias("stage"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("input_fingerprint"))
    payload = F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))
    stored = orders.where("o_orderkey % 3 <> 0").select("stage", "input_fingerprint", payload.alias("payload"), F.sha2(F.when(F.col("o_orderkey") % 2 == 0, payload).otherwise("torn"), 256).alias("payload_hash"))
    hits, misses = commit.checkpoint_hits(orders, stored)
    return hits.select("o_orderkey", F.lit(True).alias("hit")).unionByName(misses.select("o_orderkey", F.lit(False).alias("hit")))


@query(f"""
WITH e AS (SELECT event_id, [{", ".join(_q(s) for s in _STATES)}, 'lost'][1 + event_id % {len(_STATES) + 1}] AS a, [{", ".join(_q(s) for s in _STATES)}, 'lost'][1 + (event_id // 7) % {len(_STATES) + 1}] AS b, event_id % 2 = 0 AS ok, CAST(event_id % 101 AS INTEGER) AS percent FROM events)
SELECT event_id, CASE WHEN b = 'lost' THEN 'UNKNOWN_STATE' WHEN NOT ({" OR ".join(f"(a = {_q(a)} AND b IN ({', '.join(_q(x) for x in (a, *b))}))" for a, b in PRODUCTION.items())}) THEN 'PRODUCTION_STATE_TRANSITION_REJECTED'
  WHEN b = 'stored' AND NOT ok THEN 'AUTHORITATIVE_MANIFEST_REQUIRED' WHEN b = 'stored' AND percent <> 100 THEN 'COMPLETED_PERCENT_MISMATCH' END AS reason FROM e""")
def guarded_states(spark: SparkSession, sf: str) -> DataFrame:
    """T-06: why a task may not go to a production state."""
    names = F.array(*(F.lit(s) for s in (*_STATES, "lost")))
    at = lambda n: F.element_at(names, (n % (len(_STATES) + 1) + 1).cast("int"))
    k = F.col("event_id")
    return _t(spark, sf, "events").select("event_id", commit.production_transition(at(k), at(F.floor(k / 7)), k % 2 == 0, k % 101).alias("reason"))


@query("""
WITH u AS (SELECT o_custkey AS source_document_id, o_orderkey AS unit_id, unnest(list_filter([CASE WHEN o_orderstatus = 'O' THEN 'ambiguous_library_route' END, CASE WHEN o_totalprice > 200000 THEN 'material_conflict' END], lambda x: x IS NOT NULL)) AS cause FROM orders)
SELECT source_document_id, cause, 'review-' || left(sha256('["' || source_document_id || '","' || cause || '"]'), 20) AS review_id, string_agg(CAST(unit_id AS VARCHAR), '|' ORDER BY unit_id) AS unit_ids FROM u GROUP BY 1, 2""")
def unit_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """A-07: orders as units, by why they need review."""
    conflict = F.when(F.col("o_totalprice") > 200000, F.array(F.lit("material_conflict"))).otherwise(F.array().cast("array<string>"))
    planned = _t(spark, sf, "orders").select(F.col("o_custkey").alias("source_document_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("unit_id"), F.struct((F.col("o_orderstatus") == "O").alias("ambiguous")).alias("route"), conflict.alias("uncertainty"))
    return units.review_groups(planned).select("source_document_id", "cause", "review_id", F.array_join("unit_ids", "|").alias("unit_ids"))


@query("SELECT event_id, event_id % 3 <> 0 AS kept_old, '2' AS new_value FROM events")
def merged_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """X-46: unknown fields of a task stay, new values win."""
    old = F.when(F.col("event_id") % 3 != 0, F.lit('{"unknown":"kept","a":"1"}')).otherwise(F.lit('{"a":"1"}'))
    out = records.merge_unknown(old, F.lit('{"a":"2"}'))
    return _t(spark, sf, "events").select("event_id", F.get_json_object(out, "$.unknown").eqNullSafe("kept").alias("kept_old"), F.get_json_object(out, "$.a").alias("new_value"))
