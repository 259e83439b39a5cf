"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kunits.llm import adaptive_scan, chat_templates, decontamination, filter_audit, html_extraction, impact_search, order_minhash, rank_profiles, rule_ensemble, sentencepiece_codec, substring_dedup, url_rules, wordpiece_counts
from kunits.llm.common import table

#: Vocabulary file of ops 4 and 8; a parameter, the file stays where it is.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, labels = url_rules.parsed(table(spark, sf_dir, "pages")), table(spark, sf_dir, "labels")
    return url_rules.judge(rows, url_rules.mine(rows, labels), default=url_rules.default_verdict(rows, labels))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return rule_ensemble.classify(documents, rule_ensemble.train(documents, table(spark, sf_dir, "labels")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), Path(PIECES).read_bytes())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = wordpiece_counts.vocabulary(Path(PIECES).read_bytes())
    return wordpiece_counts.count_tokens(table(spark, sf_dir, "documents"), vocab)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_templates.format_digests(rows)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return rank_profiles.identify(documents, rank_profiles.learn(documents))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _escaped(column: str) -> str:
    """SQL for the length that escaping adds: one for each backslash, two for each control string."""
    controls = "|".join(c.replace("|", "\\|").replace("[", "\\[").replace("]", "\\]") for c in chat_templates.CONTROL)
    return f"(length({column}) + length(regexp_replace({column}, '[^\\\\]', '', 'g')) + 2 * len(regexp_extract_all({column}, '{controls}')))"


OP10_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat_templates.TURN + chat_templates.SAYS + chat_templates.END)} + {_escaped("role")} + {_escaped("text")}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op5_html_text": op5_html_text,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_chat_format": op10_chat_format,
    "op11_language_id": op11_language_id,
    "op12_lexical_search": op12_lexical_search,
    "op13_filter_audit": op13_filter_audit,
}
_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(list_slice(w, k, k + 9), ' '))) AS win, least(len(w), 10) AS size FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT dw.doc_id, dw.k, dw.size, iw.item FROM (SELECT doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS win FROM dw) dw JOIN iw USING (win, size)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT doc_id, k, size FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 19), ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY words ORDER BY doc_id, k) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(k, k + 20)) AS p FROM late) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
removed AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Scores every pair of an item and a document that share a term.
OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * p.n * c.n) // c.l)))) AS score FROM qt JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 20
"""

#: Walks every order over the distinct sets of failures: what fails a step's filter and none before it goes there.
OP13_SQL = """
WITH l AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(coalesce(bool_or(quality = 1), false) AS INTEGER) AS good, CAST(coalesce(bool_or(toxic = 1), false) AS INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
  CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, k, substr(o, k, 1) AS f, substr(o, 1, k - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
m AS (SELECT part, o, k, f, n, good, toxic, contains(fails, f) AS failing, translate(before, fails, '') = before AS there, translate(fails, f, '') = '' AS alone FROM c, s),
r AS (SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, f, coalesce(sum(n) FILTER (there AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (there AND failing), 0) AS removed,
  coalesce(sum(n) FILTER (failing AND NOT there), 0) AS redundant, coalesce(sum(n) FILTER (failing AND alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (there AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (there AND failing), 0) AS toxic_lost FROM m GROUP BY part, o, k, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""

ORACLE_SQL: dict[str, str] = {"op6_substring_dedup": OP6_SQL, "op2_decontamination": OP2_SQL, "op10_chat_format": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_filter_audit": OP13_SQL}
