"""Benchmark decontamination by a prefix-filtered set join, in native columns only.

Windows of benchmark items are sets of word shingles. Shingles are ordered by
rarity, counted over the whole corpus. Since every shingle of a window must
occur, the window's prefix is its rarest shingle alone; documents are joined
on it. Length and position bounds drop starts where the window doesn't fit,
and the words at that place of the text decide exact containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kunits.llm.common import fresh, text_key, written

WINDOW, SHINGLE = 10, 5
#: Distinct shingles of the benchmark that are broadcast at most (about 100 bytes each); more are joined by shuffling.
BROADCAST_SHINGLES = 400_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)  # then lower() changes A-Z alone
    return F.regexp_extract_all(F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER)), F.lit(f"({_WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_ANY_CASE)).cast("long")


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows with their items: win (array of words), size, items (array of ids as text)."""
    split = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    one = split.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("win"))
    return one.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).select("win", F.size("win").alias("size"), "items")


def shingles_of(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The shingles of each window: win, size, items, offset (from 0), length, hash."""
    length = F.least(F.col("size"), F.lit(shingle))
    placed = windows.withColumn("length", length).select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("length"))).alias("offset"))
    return placed.withColumn("hash", F.xxhash64(F.array_join(F.slice("win", F.col("offset") + 1, F.col("length")), " ")))


def placed_shingles(docs: DataFrame, key: str, text_col: str, lengths: list[int]) -> DataFrame:
    """key, at (from 1), length, hash: the shingles of all *lengths* in each text, in one pass."""
    split = docs.select(key, words(F.col(text_col)).alias("w"))
    # A row for each position with the words that follow; fewer than the longest shingle at the end of a text.
    runs = F.arrays_zip(*(F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(max(lengths))))
    placed = split.select(key, F.posexplode(runs).alias("at", "run"))

    def hashed(n: int) -> Column:
        return F.xxhash64(F.concat_ws(" ", *(F.col("run")[f"w{i}"] for i in range(n))))

    at = (F.col("at") + 1).alias("at")
    if len(lengths) == 1:
        whole = placed.where(F.col("run")[f"w{lengths[0] - 1}"].isNotNull()) if lengths[0] > 1 else placed
        return whole.select(key, at, F.lit(lengths[0]).alias("length"), hashed(lengths[0]).alias("hash"))
    each = F.array(*(F.struct(F.lit(n).alias("length"), F.when(F.col("run")[f"w{n - 1}"].isNotNull(), hashed(n)).alias("hash")) for n in lengths))
    return placed.select(key, at, F.inline(each)).where("hash is not null")


def matches(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Exact occurrences of windows in texts: key, start (from 1), size, items.

    *docs*: key, text; rows of one key have equal texts. Shingles are joined
    without the texts; only texts that hold a window's prefix are read again.
    """
    parts = written(shingles_of(windows, shingle), "shingles")
    known = parts.groupBy("hash", "length").agg(F.count("*").alias("n"))
    lengths = sorted(r.length for r in parts.select("length").distinct().limit(shingle).collect())  # at most *shingle* sizes
    if not lengths:
        return docs.sparkSession.createDataFrame([], T.StructType([docs.schema["key"], *T.StructType.fromDDL("start int, size int, items array<string>").fields]))
    few = known.count() <= BROADCAST_SHINGLES
    known = F.broadcast(known) if few else known
    seen = written(placed_shingles(docs, "key", "text", lengths).join(known.select("hash", "length"), ["hash", "length"]), "shingle-hits")
    rarity = seen.groupBy("hash", "length").agg(F.count("*").alias("freq"))
    ranked = parts.join(rarity, ["hash", "length"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    # The prefix: the rarest shingle of each window; where it never occurs the window can't.
    prefix = ranked.groupBy("win", "size", "items", "length").agg(F.min_by(F.struct("hash", "offset", "freq"), F.struct("freq", "hash", "offset")).alias("p"))
    prefix = prefix.where("p.freq > 0").select("win", "size", "items", "length", "p.hash", "p.offset")
    prefix = F.broadcast(prefix) if few else prefix  # no more windows than shingles
    start = (F.col("at") - F.col("offset")).alias("start")
    pairs = seen.join(prefix, ["hash", "length"]).select("key", start, "size", "win", "items").where("start >= 1")
    pairs = written(pairs.groupBy("key").agg(F.collect_set(F.struct("start", "size", "win", "items")).alias("asked")), "prefix-hits")
    keys = F.broadcast(pairs.select("key")) if pairs.count() <= BROADCAST_SHINGLES else pairs.select("key")
    texts = docs.select("key", "text").join(keys, "key", "left_semi").dropDuplicates(["key"])
    split = texts.join(pairs, "key").select("key", words(F.col("text")).alias("w"), "asked").select("key", "w", F.inline("asked"))
    fits = F.col("start") + F.col("size") - 1 <= F.size("w")
    return split.where(fits & (F.slice("w", F.col("start"), F.col("size")) == F.col("win"))).select("key", "start", "size", "items")


def hit_spans(found: DataFrame) -> DataFrame:
    """key, n_hit (words inside any window), n_items, items_sha256."""
    spans = F.array_sort(F.collect_set(F.struct("start", F.col("size").alias("size"))))
    each = found.groupBy("key").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("every"))

    def covered(so_far: Column, span: Column) -> Column:
        end = span["start"] + span["size"]
        more = F.greatest(end - F.greatest(span["start"], so_far["reached"]), F.lit(0))
        return F.struct((so_far["hit"] + more).alias("hit"), F.greatest(so_far["reached"], end).alias("reached"))

    hit = F.aggregate("spans", F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reached")), covered)["hit"]
    return each.select("key", hit.cast("long").alias("n_hit"), F.size("every").cast("long").alias("n_items"), F.sha2(F.array_join("every", ","), 256).alias("items_sha256"))


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of *documents*.

    Null texts and texts without words have no hits; items without words
    match nothing; null item ids count as the empty id, repeated items once.
    Repeated rows and null doc_ids get a row each; other columns don't matter.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Written first, so that Spark can split the join at a text with many copies.
    spans = written(hit_spans(matches(docs.withColumn("key", text_key("text")), item_windows(items, window), window, shingle)), "spans")
    counted = docs.select("doc_id", text_key("text").alias("key"), word_count(F.col("text")).alias("n_words"))
    zero = F.lit(0).cast("long")
    return counted.join(spans, "key", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of *documents* without any window of an item, with their own columns."""
    key = fresh(documents, "text_key")
    keyed = documents.withColumn(key, text_key(documents[text_col]))
    found = matches(keyed.select(F.col(key).alias("key"), F.col(f"`{text_col}`").alias("text")), item_windows(items, window), window)
    return keyed.join(found.select(F.col("key").alias(key)).distinct(), key, "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
