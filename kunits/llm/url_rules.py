"""URL filters by association rules.

URL tokens of labelled pages are transactions; FP-growth finds the frequent
token combinations and the rules from combinations to a verdict. Rules pass
by support and confidence; they are matched through an inverted index from
token to rule: a rule fits a URL if as many of its tokens are hit as it has.
Explicit host and path rules go before mined ones; where none fits, the more
frequent verdict of the labelled pages holds.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kunits.llm.common import written

#: Explicit rules: host, path, verdict (fixed values of the contract).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Share of the pages of its verdict that a rule covers at least; pages that it covers at least.
MIN_SUPPORT, MIN_PAGES = 0.01, 5
#: Least confidence; standard errors by which it lies above the share of its verdict among all labelled pages.
MIN_CONFIDENCE, ERRORS = 0.6, 3.0
#: Rules that are broadcast at most; beyond, the index is joined by shuffling.
BROADCAST_RULES = 20_000
VERDICT = "verdict="


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``; A-Z in lower case; empty without ``://``."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def explicit_rule(host_col: Column, path_col: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host_col: Column, path_col: Column) -> Column:
    """Distinct tokens of a URL: all labels, words and suffixes of its host, all segments of its path but numbers, all parameters."""
    whole = F.coalesce(url, F.lit(""))
    labels = F.array_remove(F.split(host_col, r"\."), "")
    segments = F.array_remove(F.split(path_col, "/"), "")
    query = F.array_remove(F.split(F.regexp_extract(whole, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), "")
    keys = F.array_remove(F.transform(query, lambda q: F.substring_index(q, "=", 1)), "")

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(f"{kind}="), v))

    def word_like(values: Column) -> Column:
        return F.filter(values, lambda v: ~v.rlike(r"^\d*$"))

    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    single = F.array_compact(
        F.array(
            F.concat(F.lit("scheme="), F.lower(F.nullif(F.regexp_extract(whole, r"(?s)^(.*?)://", 1), F.lit("")))),
            F.concat(F.lit("first="), F.try_element_at(word_like(F.slice(segments, 1, 1)), F.lit(1))),
            F.when(path_col.rlike(r"\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("type="), F.lower(F.regexp_extract(path_col, r"\.([A-Za-z0-9]{1,5})$", 1)))),
            F.when(whole.contains("#"), F.lit("fragment")),
            F.concat(F.lit("depth="), F.size(segments).cast("string")),
        )
    )
    words = F.filter(F.flatten(F.transform(labels, lambda v: F.split(v, "-"))), lambda v: v != "")
    return F.array_distinct(F.concat(single, named("host", suffixes), named("word", word_like(words)), named("segment", word_like(segments)), named("query", keys), named("value", word_like(F.transform(query, lambda q: F.regexp_replace(q, r"=\d+$", ""))))))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, tokens."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    return rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))


def labelled_documents(labels: DataFrame) -> DataFrame:
    """doc_id, bad: whether any label of the document is of low quality or toxic."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("bad"))


def document_of(url: Column) -> Column:
    """Id of the document that a page shows: the number that ends its path, before an extension."""
    return F.regexp_extract(path(url), r"/(\d{1,18})(?:\.[A-Za-z0-9]+|/)?$", 1).try_cast("long")


def _known(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled pages: page (one number for each row), tokens, bad."""
    known = rows.withColumn("doc_id", document_of(F.col("url"))).join(labelled_documents(labels), "doc_id")
    return known.select(F.monotonically_increasing_id().alias("page"), "tokens", "bad")


def default_verdict(rows: DataFrame, labels: DataFrame) -> str:
    """The more frequent verdict of labelled pages; allow for ties and without labels."""
    count = _known(rows, labels).agg(F.count_if("bad").alias("bad"), F.count("*").alias("n")).head()
    return "block" if 2 * count.bad > count.n else "allow"


def mine(
    rows: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, errors: float = ERRORS
) -> DataFrame:
    """Rules of all labelled pages: rule_id, tokens, verdict, confidence, support.

    *rows* as :func:`parsed`. A rule covers *min_pages* and *min_support* of
    its verdict's pages at least, and is *errors* standard errors more
    confident than chance (by Wilson's bound). Of tokens that occur on the
    same labelled pages the least stands for all, so that a URL of many parts,
    repeated however often, makes few combinations. A rule goes if one with
    fewer of its tokens and the same verdict is as confident. No labelled
    page, no rules.
    """
    spark = rows.sparkSession
    known = written(_known(rows, labels), "labelled-pages")
    empty = T.StructType.fromDDL("rule_id string, tokens array<string>, verdict string, confidence double, support double")
    count = known.agg(F.count_if("bad").alias("block"), F.count("*").alias("n")).head()
    if not count.n:
        return spark.createDataFrame([], empty)
    shares = {"block": count.block / count.n, "allow": 1 - count.block / count.n}
    least = {v: max(min_pages, min_support * s * count.n) for v, s in shares.items()}
    each = known.select("page", "bad", F.explode("tokens").alias("token"))
    pages_of = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("page").cast("decimal(38,0)")).alias("pages")).where(F.col("n") >= min(least.values()))
    stands = pages_of.groupBy("n", "pages").agg(F.min("token").alias("token")).select("token")
    baskets = each.join(stands, "token").groupBy("page", "bad").agg(F.collect_list("token").alias("tokens"))
    items = F.array_append("tokens", F.concat(F.lit(VERDICT), F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))))
    baskets = written(baskets.select(items.alias("items")), "baskets")
    if baskets.isEmpty():
        return spark.createDataFrame([], empty)
    baskets_n = baskets.count()  # pages without a frequent token are in no rule, but count as pages
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, min_confidence * min(least.values()) / baskets_n), minConfidence=min_confidence).fit(baskets).associationRules
    told = F.element_at("consequent", 1)
    share, enough = (F.when(told == VERDICT + "block", F.lit(of["block"])).otherwise(F.lit(of["allow"])) for of in (shares, least))
    p, n = F.col("confidence"), F.col("support") * baskets_n / F.col("confidence")
    z = errors * errors
    bound = (p + z / (2 * n) - errors * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
    rules = (
        found.where(told.startswith(VERDICT) & ~F.exists("antecedent", lambda t: t.startswith(VERDICT)) & (n >= enough - 1e-6) & (bound > share))
        .select(F.array_sort("antecedent").alias("tokens"), F.substring(told, len(VERDICT) + 1, 99).alias("verdict"), "confidence", "support")
        .withColumn("rule_id", F.concat_ws(" ", "tokens", "verdict"))
    )
    rules = written(rules, "rules")
    shorter = rules.select(F.explode("tokens").alias("left_out"), "*").select("rule_id", "verdict", "confidence", F.array_remove("tokens", F.col("left_out")).alias("tokens"))
    implied = shorter.alias("a").join(rules.alias("b"), (F.col("a.tokens") == F.col("b.tokens")) & (F.col("a.verdict") == F.col("b.verdict")) & (F.col("b.confidence") >= F.col("a.confidence"))).select("a.rule_id").distinct()
    return rules.join(implied, "rule_id", "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support")


def judge(rows: DataFrame, rules: DataFrame, explicit: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of *rows* (as :func:`parsed`).

    Of the mined rules that fit the most confident decides, then the one of
    most support, then the first by name; without any the *default* holds. Null
    urls have no host, path or rule; repeated rows are judged each.
    """
    rules = written(rules, "mined")
    count = rules.count()
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), explicit)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    if not count:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    index = rules.select("rule_id", F.col("verdict").alias("mined"), "confidence", "support", F.size("tokens").alias("needs"), F.explode("tokens").alias("token"))
    index = F.broadcast(index) if count <= BROADCAST_RULES else index
    rows = rows.withColumn("signature", F.when(F.col("verdict").isNull(), F.md5(F.concat_ws("\n", F.array_sort("tokens")))))
    urls = rows.where("signature is not null").groupBy("signature").agg(F.first("tokens").alias("tokens"))
    hits = urls.select("signature", F.explode("tokens").alias("token")).join(index, "token")
    fits = hits.groupBy("signature", "rule_id", "mined", "confidence", "support", "needs").agg(F.count("*").alias("n")).where("n = needs")
    best = fits.groupBy("signature").agg(F.min(F.struct(-F.col("confidence"), -F.col("support"), "rule_id", "mined"))["mined"].alias("mined"))
    # Written first, so that Spark can split the join at a common signature.
    return rows.join(written(best, "judged"), "signature", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit(default)).alias("verdict"))
