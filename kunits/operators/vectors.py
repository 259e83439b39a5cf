"""Similarity: SimHash, cosine, exact top-k, relation guards, consolidation of paraphrases."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kunits.functions import lang


def md5_long(word: Column) -> Column:
    """The first 64 bits of a word's MD5: a hash that other engines have too."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 16), 16, -10).cast("long")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """*then* of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


#: Hashes whose bits are laid out at a time.
BITS_AT_ONCE = 1 << 16


def majorities(hashes: pa.Array) -> np.ndarray:
    """For each list of longs the long of all bits that more than half of them have."""
    flat, ends = hashes.flatten().to_numpy(zero_copy_only=False), np.cumsum(hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    counts = np.zeros((len(hashes), 64), np.int64)
    for at in range(0, len(flat), BITS_AT_ONCE):
        piece = np.ascontiguousarray(flat[at : at + BITS_AT_ONCE], "<i8")
        bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = np.flatnonzero((ends > at) & (starts < at + len(piece)) & (ends > starts))
        counts[own] += np.add.reduceat(bits, np.maximum(starts[own] - at, 0), axis=0, dtype=np.int64)
    most = counts * 2 > (ends - starts)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<i8").ravel()


@F.arrow_udf(T.LongType())
def _majority(hashes: pa.Array) -> pa.Array:
    return pa.array(majorities(hashes), pa.int64())


@F.arrow_udf(T.LongType())
def _md5_majority(words: pa.Array) -> pa.Array:
    """As :func:`_majority` of :func:`md5_long` of the words; a batch's different words are hashed once."""
    coded = words.flatten().dictionary_encode()
    known = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big", signed=True) for w in coded.dictionary.to_pylist()], np.int64)
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    flat = known[coded.indices.to_numpy()] if len(known) else known
    return pa.array(majorities(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int64()))), pa.int64())


def simhash(text: Column, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """64-bit SimHash of a text's lower-case words: each bit is the majority over the words' hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _md5_majority(words) if hashed is md5_long else _majority(F.transform(words, lambda w: hashed(w)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is zero."""
    return F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0))


#: Queries that are broadcast at most; more are joined by their filter columns, or searched in blocks.
BROADCAST_QUERIES = 10_000
#: Pairs of a row and a query up to which they are scored in native columns.
NATIVE_PAIRS = 4_000_000


def top_k_cosine(index: DataFrame, query: DataFrame, k: int, vector: str = "vector", key: str = "id", filters: list[str] | None = None, limit: int = 0) -> DataFrame:
    """query_id, id, score, rank: exact search among rows of equal filter columns.

    Rows and queries are counted: beyond NATIVE_PAIRS they go the way of
    :func:`top_k_cosine_many`, up to it in native columns. With *limit* only
    so many candidates a query, the first by key, are scored: the hard cap is
    the feature.
    """
    asked = query.count()
    few = asked <= BROADCAST_QUERIES
    if not limit and (asked * index.count() > NATIVE_PAIRS or not few and not filters):
        return top_k_cosine_many(index, query, k, vector, key, filters)
    q = query.select(F.col(key).alias("query_id"), F.col(vector).alias("_q"), *(filters or []))
    q = F.broadcast(q) if few else q
    rows = index.join(q, filters) if filters else index.crossJoin(q)
    if limit:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(key))).where(F.col("_n") <= limit)
    rows = rows.where(F.col(key) != F.col("query_id")).withColumn("score", cosine(F.col(vector), F.col("_q")))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


#: Rows of the index and of the queries, about, in one block of a search of many queries.
INDEX_BLOCK, QUERY_BLOCK = 20_000, 2_000
#: Queries of a block that are compared in one product of matrices.
QUERIES_AT_ONCE = 64


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; those that are null, incomplete or of another length are zero, so that their cosine is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, out = column.flatten(), np.zeros((len(column), width))  # a null vector has no values here
    whole = sizes == width if width else np.zeros(len(column), bool)
    if flat.null_count:
        whole[np.repeat(np.arange(len(sizes)), sizes)[np.asarray(flat.is_null())]] = False
        flat = flat.fill_null(0)
    out[whole] = flat.to_numpy(zero_copy_only=False)[np.repeat(whole, sizes)].reshape(int(whole.sum()), width)
    return out


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed in the order of :func:`_dot`, so that equal vectors have equal scores."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[..., i]
    return out


def best_of_block(left: pa.Table, right: pa.Table, k: int, width: int | None = None, looked_at: Callable[[int, int], np.ndarray] | None = None) -> pa.Table:
    """query_id, id, score: the *k* best rows of *left* (id, v) for each query of *right*, itself left out.

    *looked_at* tells for some queries (from, to) which rows each of them
    looks at, all if it isn't given; vectors are of *width*, the largest of
    the block if it isn't given.
    """
    ids, asked = left.column("id").to_numpy(), right.column("id").to_numpy()
    found: list[tuple] = []
    if width is None:
        width = max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (left.column("v"), right.column("v")))
    rows, wanted = matrix(left.column("v"), width), matrix(right.column("v"), width)
    size, length = np.sqrt(_fold(rows, rows)), np.sqrt(_fold(wanted, wanted))
    unit = np.divide(rows, size[:, None], out=np.zeros_like(rows), where=size[:, None] > 0)
    for at in range(0, len(asked), QUERIES_AT_ONCE):
        to = min(at + QUERIES_AT_ONCE, len(asked))
        seen = looked_at(at, to) if looked_at else np.ones((to - at, len(ids)), bool)
        held = np.flatnonzero(seen.any(axis=0))
        rough = (wanted[at:to] / np.where(length[at:to] > 0, length[at:to], 1.0)[:, None]) @ (unit if len(held) == len(ids) else unit[held]).T
        for i, near in enumerate(rough, at):
            there = np.flatnonzero(seen[i - at, held] & (ids[held] != asked[i]))
            if len(there) > k:  # all that may be among the best, whatever the rounding
                near = near[there]
                there = there[~(near < np.partition(near, -k)[-k] - 1e-9)]
            others = held[there]
            below = size[others] * length[i]
            score = np.divide(_fold(rows[others], wanted[i]), below, out=np.zeros(len(others)), where=below > 0)
            for j in np.lexsort((ids[others], -np.where(np.isnan(score), np.inf, score)))[:k]:  # as Spark sorts
                found.append((asked[i], ids[others[j]], score[j]))
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table({"query_id": pa.array(columns[0], right.schema.field("id").type), "id": pa.array(columns[1], left.schema.field("id").type), "score": pa.array(columns[2], pa.float64())})


def top_k_cosine_many(index: DataFrame, query: DataFrame, k: int, vector: str = "vector", key: str = "id", filters: list[str] | None = None, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank as :func:`top_k_cosine`, of any number of queries.

    Both sides are dealt into blocks, every block of queries meets every block
    of the index, and nothing is broadcast. A block keeps its *k* best rows of
    each query, so the best of all are among them.
    """
    names = list(filters or [])
    if names:  # a null is equal to nothing
        index, query = index.dropna(subset=names), query.dropna(subset=names)
    parts, turns = (max(1, -(-df.count() // most)) for df, most in ((index, index_block), (query, query_block)))
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), *names]
    a = index.select(*own, block(parts).alias("_part"), every(turns).alias("_turn"))
    b = query.select(*own, block(turns).alias("_turn"), every(parts).alias("_part"))
    kind = index.schema[key].dataType

    by = [*names, "_part", "_turn"]
    scored = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(lambda x, y: best_of_block(x, y, k), f"query_id {kind.simpleString()}, id {kind.simpleString()}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(key), "score", "rank")


def tombstoned(index: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return index.join(removed.select(key), key, "left_anti")


def guard(a: Column, b: Column) -> Column:
    """Whether two texts agree on numbers and on version labels."""
    numbers = lambda t: F.array_sort(F.transform(lang.extract_numbers(t, True), lambda n: F.lower(F.regexp_replace(n, r"\s+", ""))))
    version = lambda t: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"\bv?\d+\.\d+(?:\.\d+)?\b"), F.lit(0))))
    return (numbers(a) == numbers(b)) & (version(a) == version(b))


def infer_relation(a: Column, b: Column, score: Column, least: float = 0.8) -> Column:
    """supersedes, related or none for two similar texts."""
    newer = F.lower(a).rlike(r"替代|取代|废止|supersede|replace|修订|更新版")
    return F.when(score < least, "none").when(newer | ~guard(a, b), F.when(newer, "supersedes").otherwise("none")).otherwise("related")


def consolidate_atoms(atoms: DataFrame, doc: str = "source_document_id", text_col: str = "text", most: int = 32) -> DataFrame:
    """Adds group_id: atoms of one document, figures and modality within *most* bits of SimHash of the group's leader.

    Different figures or modality stay apart, since they are the blocking key;
    atoms without words go as noise. Within a block every atom is compared
    with the leaders before it, in order of ids, so two paraphrases meet
    whatever stands before them (:func:`similar.leader_groups`).
    """
    from kunits.operators.provenance import modality
    from kunits.operators.similar import leader_groups

    rows = atoms.where(F.col(text_col).rlike(r"[\p{L}\p{N}]"))
    figures = F.array_join(F.array_sort(F.concat(lang.extract_numbers(F.col(text_col), True), lang.extract_dates(F.col(text_col)))), "|")
    rows = rows.withColumns({"_sim": simhash(F.col(text_col)), "_key": F.concat_ws("#", figures, modality(F.col(text_col)))})
    grouped = leader_groups(rows.select(doc, "_key", "atom_id", "_sim"), [doc, "_key"], "atom_id", most, "_sim")
    found = grouped.select(F.col(doc).alias("_doc"), F.col("atom_id").alias("_atom"), F.col("leader").alias("group_id")).distinct()
    return rows.join(found, F.col(doc).eqNullSafe(F.col("_doc")) & F.col("atom_id").eqNullSafe(F.col("_atom"))).drop("_sim", "_key", "_doc", "_atom")


def reverse_relations(edges: DataFrame) -> DataFrame:
    """target, sources: who points to each target."""
    return edges.groupBy("target").agg(F.array_sort(F.collect_set(F.struct("source", "type"))).alias("sources"))


def privacy_projection(cards: DataFrame, keep: tuple[str, ...] = ("card_id", "title", "category", "tag", "library", "claim_summary", "kind", "status", "version", "updated_at")) -> DataFrame:
    """Only the ten named fields survive, those that are there."""
    return cards.select(*(c for c in keep if c in cards.columns))
