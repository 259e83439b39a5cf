"""Queries of similar signatures, quotes, evolution, schemas and chunks over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.operators import blocks as B
from kunits.operators import lineage, pivots, quotes, schemas, similar, spans, summaries, vectors
from kunits.plans.queries import _t, query
from kunits.session import parts_of

#: Bits in which texts (of documents, of their lines) may differ.
NEAR, LINE_NEAR = 3, 20


def _signature_sql(rows: str, key: str) -> str:
    """SQL for *key*, m: the SimHash over MD5 of the words of (key, text)."""
    return f"""
t AS ({rows}),
w AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM t),
h AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 16) AS UBIGINT) AS h, count(*) AS n FROM w GROUP BY ALL),
p AS (SELECT i, CAST(pow(2, i) AS UBIGINT) AS p FROM (SELECT unnest(range(64)) AS i)),
b AS (SELECT {key}, p, sum(CASE WHEN h & p = p THEN n ELSE -n END) AS s FROM h, p GROUP BY ALL),
g AS (SELECT {key}, CAST(sum(CASE WHEN s > 0 THEN p ELSE 0 END) AS UBIGINT) AS m FROM b GROUP BY ALL),
s AS (SELECT {key}, coalesce(m, 0) AS m FROM (SELECT DISTINCT {key} FROM t) LEFT JOIN g USING ({key}))"""


_DOCUMENTS = _signature_sql("SELECT doc_id, text FROM documents", "doc_id")
_CLASSES = f"{_DOCUMENTS}, c AS (SELECT m, min(doc_id) AS class_id, count(*) AS n FROM s GROUP BY m), l AS (SELECT a.m, a.class_id AS a, b.class_id AS b, a.n AS an, b.n AS bn, CAST(bit_count(xor(a.m, b.m)) AS INTEGER) AS d FROM c a, c b WHERE a.m != b.m AND bit_count(xor(a.m, b.m)) <= {NEAR})"


def _signed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", vectors.simhash(F.col("text"), vectors.md5_long).alias("mark"))


@query(f"WITH {_CLASSES} SELECT a AS left_id, b AS right_id, an AS left_n, bn AS right_n, d AS distance FROM l WHERE a < b")
def simhash_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """X-33: classes of documents whose SimHashes differ in few bits."""
    return similar.class_pairs(_signed_documents(spark, sf), "doc_id", NEAR)


@query(f"""WITH {_CLASSES}, k AS (SELECT m, count(*) AS n_links, min(d) AS nearest FROM l GROUP BY m)
SELECT doc_id, class_id, n AS n_same, coalesce(n_links, 0) AS n_links, nearest FROM s JOIN c USING (m) LEFT JOIN k USING (m)""")
def simhash_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """X-33: each document with its class of equal SimHashes and the number of near classes."""
    return similar.neighbours(_signed_documents(spark, sf), "doc_id", NEAR)


_LINES = "SELECT doc_id, i - 1 AS line, trim(l[i], ' ') AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(f"""WITH {_signature_sql(_LINES, "doc_id, line")},
f AS (SELECT doc_id, list_reduce(list([{{'line': line, 'm': m}}] ORDER BY line), lambda a, x: CASE WHEN len(list_filter(a, lambda y: bit_count(xor(y.m, x[1].m)) < {LINE_NEAR})) > 0 THEN a ELSE list_concat(a, x) END) AS leaders FROM s GROUP BY doc_id)
SELECT doc_id, line, list_filter(leaders, lambda y: bit_count(xor(y.m, m)) < {LINE_NEAR})[1].line AS leader FROM s JOIN f USING (doc_id)""")
def line_leaders(spark: SparkSession, sf: str) -> DataFrame:
    """X-32: lines of a document under the first line that says nearly the same."""
    lines = B.line_blocks(_t(spark, sf, "documents")).select("doc_id", F.col("ord").cast("long").alias("line"), vectors.simhash(F.trim("text"), vectors.md5_long).alias("mark"))
    return similar.leader_groups(lines, ["doc_id"], "line", LINE_NEAR).select("doc_id", "line", "leader")


_PIECES = "SELECT doc_id, CAST(doc_id AS VARCHAR) || ':' || (i - 1) AS quote_id, l[i] AS quote, CASE WHEN i % 2 = 1 THEN CAST(i - 1 AS VARCHAR) END AS hint FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents))"


@query(f"""
WITH q AS ({_PIECES}), l AS ({_LINES}),
h AS (SELECT quote_id, hint, CAST(line AS VARCHAR) AS block, contains(l.text, quote) AS exact FROM q JOIN l USING (doc_id)
  WHERE regexp_replace(quote, '\\s+', '', 'g') != '' AND contains(regexp_replace(l.text, '\\s+', '', 'g'), regexp_replace(quote, '\\s+', '', 'g'))),
a AS (SELECT quote_id, bool_or(exact) AS exact FROM h GROUP BY quote_id),
p AS (SELECT quote_id, a.exact, count(*) AS n, min(block) AS first, min(block) FILTER (block = hint) AS hinted FROM h JOIN a USING (quote_id) WHERE h.exact OR NOT a.exact GROUP BY ALL)
SELECT quote_id, CASE WHEN n IS NULL THEN 'quote_not_found' WHEN n = 1 OR hinted IS NOT NULL THEN 'resolved' ELSE 'ambiguous_quote' END AS status,
  CASE WHEN n = 1 OR hinted IS NOT NULL THEN coalesce(hinted, first) END AS block_id, coalesce(exact, false) AS exact, coalesce(n, 0) AS n_blocks FROM q LEFT JOIN p USING (quote_id)""")
def reconciled_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """X-31, J-22: sentences of each document as quotes, with the lines that hold them."""
    docs = _t(spark, sf, "documents")
    sentences = docs.select("doc_id", F.posexplode(F.split("text", r"\. ", -1)).alias("n", "quote"))
    asked = sentences.select("doc_id", F.concat_ws(":", "doc_id", "n").alias("quote_id"), "quote", F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).alias("hint"))
    lines = B.line_blocks(docs).select("doc_id", F.col("ord").cast("string").alias("block_id"), F.trim("text").alias("text"), F.lit(True).alias("card_eligible"))
    return quotes.reconcile(asked, lines, "doc_id")


def _evolution_sql(records: str, edges: str) -> str:
    return f"""
WITH RECURSIVE r AS ({records}), e AS ({edges}),
k AS (SELECT source, target, max(o) AS o FROM e WHERE source IN (SELECT id FROM r) AND target IN (SELECT id FROM r) GROUP BY ALL),
n AS (SELECT target AS id, arg_max(source, {{'o': o, 's': source}}) AS next, count(*) AS n_successors FROM k GROUP BY target),
walk AS (SELECT id, id AS here, 0 AS depth, [id] AS seen FROM r UNION ALL SELECT walk.id, n.next, walk.depth + 1, list_append(seen, n.next) FROM walk JOIN n ON n.id = walk.here WHERE NOT list_contains(seen[:-2], walk.here)),
last AS (SELECT id, arg_max(here, depth) AS here, max(depth) AS depth, arg_max(seen, depth) AS seen FROM walk GROUP BY id)
SELECT id, CASE WHEN ring THEN NULL ELSE here END AS newest, CAST(CASE WHEN ring THEN NULL ELSE depth END AS BIGINT) AS depth, CASE WHEN NOT ring THEN 'none' WHEN here = id THEN 'on' ELSE 'into' END AS cycle, coalesce(n_successors, 0) AS n_successors
FROM (SELECT *, list_contains(seen[:-2], here) AS ring FROM last) LEFT JOIN n USING (id)"""


@query(_evolution_sql("SELECT o_orderkey AS id FROM orders", "SELECT o_orderkey AS source, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target, o_orderdate AS o FROM orders"))
def order_evolution(spark: SparkSession, sf: str) -> DataFrame:
    """J-21: each order supersedes its customer's order before it; the newest of each, and how far it is."""
    orders = _t(spark, sf, "orders")
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.select(F.col("o_orderkey").alias("source"), before.alias("target"), F.lit(lineage.SUPERSEDES).alias("type"), F.col("o_orderdate").alias("order"))
    return lineage.evolution_index(orders, edges, key="o_orderkey")


@query(_evolution_sql("SELECT p_partkey AS id FROM part", "SELECT l_partkey AS source, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS target, l_shipdate AS o FROM lineitem"))
def part_evolution(spark: SparkSession, sf: str) -> DataFrame:
    """J-21: a part supersedes the part on the line before it; forks, and rings of parts that have no newest one."""
    lines = _t(spark, sf, "lineitem")
    lines = lines.repartition(parts_of(lines), "l_orderkey")
    before = F.lag("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate"))
    edges = lines.select(F.col("l_partkey").alias("source"), before.alias("target"), F.lit(lineage.SUPERSEDES).alias("type"), F.col("l_shipdate").alias("order"))
    return lineage.evolution_index(_t(spark, sf, "part"), edges, key="p_partkey")


EVENT_PROPS = {"type": "object", "required": ["k", "source"], "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 89, "not": {"enum": [7, 77]}}}, "additionalProperties": False}


@query("""
WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, concat_ws(' ', '$.source:required', CASE WHEN k < 5 THEN '$.k:minimum' END, CASE WHEN k > 89 THEN '$.k:maximum' END, CASE WHEN k IN (7, 77) THEN '$.k:not' END) AS errors FROM k""")
def event_schema(spark: SparkSession, sf: str) -> DataFrame:
    """X-44: properties of events against a schema."""
    return _t(spark, sf, "events").select("event_id", F.array_join(schemas.violations(F.col("props"), EVENT_PROPS), " ").alias("errors"))


ORDER_SCHEMA = {
    "type": "object", "required": ["id", "lines"], "properties": {
        "id": {"type": "integer", "exclusiveMinimum": 0},
        "lines": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/line"}},
    }, "$defs": {"line": {"type": "object", "required": ["quantity"], "properties": {
        "quantity": {"type": "number", "maximum": 45}, "flag": {"enum": ["A", "N"]}, "ship": {"type": "string", "format": "date", "pattern": "^199[2-7]"},
    }}},
}


@query("""
WITH l AS (SELECT l_orderkey, l_quantity, l_returnflag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) - 1 AS i FROM lineitem),
e AS (SELECT l_orderkey, i, concat_ws(' ', CASE WHEN l_quantity > 45 THEN '$.lines[' || i || '].quantity:maximum' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN '$.lines[' || i || '].flag:enum' END, CASE WHEN ship NOT SIMILAR TO '199[2-7].*' THEN '$.lines[' || i || '].ship:pattern' END) AS e FROM l)
SELECT l_orderkey, concat_ws(' ', CASE WHEN l_orderkey <= 0 THEN '$.id:exclusiveMinimum' END, CASE WHEN count(*) < 2 THEN '$.lines:minItems' END, nullif(string_agg(nullif(e, ''), ' ' ORDER BY i), '')) AS errors FROM e GROUP BY l_orderkey""")
def order_schema(spark: SparkSession, sf: str) -> DataFrame:
    """X-44: each order with its lines as nested JSON, against a schema with references, items, formats and bounds."""
    ship = F.col("l_shipdate").cast("date").cast("string").alias("ship")
    line = F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_returnflag").alias("flag"), ship)
    orders = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    said = F.to_json(F.struct(F.col("l_orderkey").alias("id"), "lines"))
    return orders.select("l_orderkey", F.array_join(schemas.violations(said, ORDER_SCHEMA), " ").alias("errors"))


_ATOMS = """
WITH p AS (SELECT o_custkey AS doc, CAST(o_orderkey AS VARCHAR) AS point, CAST(o_orderkey AS VARCHAR) || '-' || o_orderstatus AS ev FROM orders WHERE o_orderstatus != 'P'),
a AS (SELECT o_custkey AS doc, CAST(l_orderkey AS VARCHAR) AS k, l_linenumber AS n, l_returnflag AS f, count(*) AS times FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
j AS (SELECT a.*, p.point, p.ev, CASE WHEN f = 'R' AND n % 2 = 0 THEN 'no_point_attribution' WHEN p.point IS NULL THEN 'point_id_mismatch' ELSE 'kept' END AS outcome FROM a LEFT JOIN p ON a.doc = p.doc AND a.k = p.point)"""


def _normalised_atoms(spark: SparkSession, sf: str) -> tuple:
    """Lines of orders as atoms of their customer, orders as its points: some lines name none, some an order that is no point."""
    orders, key = _t(spark, sf, "orders"), F.col("o_orderkey").cast("string")
    points = orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("doc"), key.alias("point_id"), F.array(F.concat_ws("-", key, "o_orderstatus")).alias("evidence_ids"))
    evidence = points.select("doc", F.explode("evidence_ids").alias("evidence_id"), F.concat(F.lit("order "), "point_id").alias("quote"), F.lit("b").alias("block_id"))
    lines = _t(spark, sf, "lineitem").join(orders.select("o_orderkey", F.col("o_custkey").alias("doc")), F.col("l_orderkey") == F.col("o_orderkey"))
    named = F.col("l_orderkey").cast("string")
    silent = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0)
    atoms = lines.select("doc", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_returnflag").alias("atom_id"), F.when(~silent & (F.col("l_returnflag") == "A"), F.array(named, F.lit(" nowhere "), named)).alias("content_point_ids"), F.when(~silent & (F.col("l_returnflag") != "A"), F.array(named)).alias("point_ids")).distinct()
    return summaries.normalise_atoms(atoms, points, evidence, "doc")


@query(f"{_ATOMS} SELECT doc, k || ':' || n || ':' || f AS atom_id, point AS first_point, 1 AS n_points, 'order ' || point AS evidence_quote FROM j WHERE outcome = 'kept'")
def normalised_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """X-43: atoms with explicit, known points alone, and the evidence of the first."""
    return _normalised_atoms(spark, sf)[0].select("doc", "atom_id", F.col("point_ids")[0].alias("first_point"), F.size("point_ids").alias("n_points"), "evidence_quote")


@query(f"""{_ATOMS} SELECT count(*) AS atoms, count(*) FILTER (outcome = 'kept') AS kept, count(*) FILTER (outcome = 'no_point_attribution') AS dropped_no_point_attribution,
  count(*) FILTER (outcome = 'point_id_mismatch') AS dropped_point_id_mismatch, CAST(sum(CASE WHEN outcome = 'no_point_attribution' THEN 0 ELSE (f = 'A')::INT + (point IS NULL)::INT END) AS BIGINT) AS unknown_point_ids FROM j""")
def atom_drop_counts(spark: SparkSession, sf: str) -> DataFrame:
    """X-43: why atoms went, counted by the pass that wrote the others."""
    kept, counts = _normalised_atoms(spark, sf)
    kept.write.format("noop").mode("overwrite").save()
    said = counts.get
    return spark.createDataFrame([tuple(said.values())], ", ".join(f"{name} long" for name in said))


@query("""
WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '[\x00-\x08\x0E-\x1F\x7F]+', '', 'g') AS t, length(text) AS size FROM documents)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, sha256(substr(t, k * 6000 + 1, 6000)) AS chunk_hash, sha256(substr(t, k * 6000 + 1, 6000)) AS source_hash, length(t) > 6000 AS bounded,
  CASE WHEN k = greatest((length(t) + 5999) // 6000, 1) - 1 THEN size END AS ends_at
FROM (SELECT *, unnest(range(greatest((length(t) + 5999) // 6000, 1))) AS k FROM n)""")
def bounded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """C-34: chunks of normalised texts, and what their spans cut out of the source once that is normalised."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    made = spans.chunks(docs, "doc_id").join(docs.select("doc_id", F.col("text").alias("source")), "doc_id")
    cut = F.substring("source", F.col("source_start") + 1, F.col("source_end") - F.col("source_start"))
    again = F.regexp_replace(F.regexp_replace(cut, r"[ \t\n\x0B\f\r]+", " "), r"[\x00-\x08\x0E-\x1F\x7F]+", "")
    last = F.when(F.col("source_end") == F.char_length("source"), F.col("source_end").cast("long"))
    return made.select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("chunk_hash"), F.sha2(again, 256).alias("source_hash"), "bounded", last.alias("ends_at"))


@query("""
WITH q AS (SELECT vec_id AS query_id, label, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS score FROM embeddings v JOIN q ON v.label = q.label WHERE v.vec_id <> query_id)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def topk_cosine_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """L-03, P-16: as topk_cosine_all, but a query only meets the cells of pivots that may hold one of its ten nearest."""
    v = _t(spark, sf, "embeddings")
    found, _ = pivots.top_k_cosine_pruned(v, v.where("vec_id % 20 = 0"), 10, "embedding", "vec_id", ["label"])
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
