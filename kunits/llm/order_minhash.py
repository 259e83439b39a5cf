"""Near-duplicates by Order MinHash, verified by banded alignment.

The k-mers are five-word shingles, each labelled with its occurrence number.
Each of several hash functions picks the few least labelled k-mers of a text
and keeps them in text order; texts that agree in such a sketch are likely to
be close in edit distance. Candidates are aligned: labelled k-mers are unique
within a text, so the longest common subsequence within the band is a longest
increasing run of matched places. The similarity is matched / (a + b - matched).

Equal texts are one node. Nodes of a bucket are compared with a leader first,
which joins most of a group. What may still link two components is found among
the candidates by their rarest k-mers: a pair of this similarity has a common
one early in the order of both (prefix filter), and few that only one has. Both
are necessary conditions, so no candidate is lost and unlike members of a large
group aren't compared. Classes are connected components, so a pair within one
need not be compared.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kunits.llm.common import fresh, lean, text_key, written

#: Words of a k-mer, least similarity, hash functions, k-mers of a sketch.
SHINGLE, SIMILARITY, FUNCTIONS, KEPT = 5, 0.8, 30, 5
#: Texts of so few k-mers, and those that may be similar to them, take sketches of two k-mers by the last third of the functions too.
SHORT, SHORT_KEPT = 16, 2
#: Rounds with one leader a bucket; random orders of a round's leaders.
ROUNDS, ORDERS = 2, 3
#: Sketches that a longer text shares with a leader to be compared with it. Of 30, texts of similarity 0.8 share about
#: ten. Pairs that share fewer aren't left out: they are compared after the rounds with leaders.
AGREED = 3
#: Rarest k-mers of a text that stand beside each of them, to bound what a pair has in common.
HEAD = 32
#: For sums of fractions that should be whole numbers.
SLACK = 1e-6
#: Keys of 16 bytes, each with a number, that are broadcast at most; beyond, texts are joined by shuffling.
BROADCAST_KEYS = 400_000
#: Word hashes that a worker keeps.
KEPT_HASHES = 150_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(17).integers(1, 2**63, 256).astype(np.uint64)
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_HASHES:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def labelled(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's occurrence-labelled k-mers in text order.

    Words are runs of letters and digits in lower case. A text of fewer words
    than a k-mer has one k-mer of all its words; without words it has none.
    """
    found = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    size = min(shingle, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        out = out * _M1 + h[i : i + len(out)]
    out = _mixed(out)
    order = np.argsort(out, kind="stable")
    new = np.r_[True, out[order][1:] != out[order][:-1]]
    if not new.all():
        at = np.arange(len(out))
        nth = np.empty(len(out), np.uint64)
        nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        out = np.where(nth > 0, _mixed(out + nth * _M2), out)
    return out


def sketches(kmers: np.ndarray, functions: int = FUNCTIONS, kept: int = KEPT, least: float = SIMILARITY) -> np.ndarray:
    """One 64-bit hash for each function: its least k-mers, in text order.

    A difference of one k-mer counts for much in a short text, so those have
    smaller sketches too, and so have texts that may be similar to a short one.
    """
    found = _least(kmers, 0, functions, kept)
    if len(kmers) * least > SHORT:
        return found
    return np.concatenate([found, _least(kmers, functions - functions // 3, functions, SHORT_KEPT)])


def _least(kmers: np.ndarray, low: int, high: int, kept: int) -> np.ndarray:
    seeds = _SEEDS[low:high]
    if len(kmers) <= kept:
        least = np.tile(np.arange(len(kmers)), (len(seeds), 1))
    elif len(kmers) > 100_000:  # one function at a time, to bound memory
        least = np.stack([np.argpartition(_mixed(kmers ^ s), kept - 1)[:kept] for s in seeds])
    else:
        least = np.argpartition(_mixed(kmers[None, :] ^ seeds[:, None]), kept - 1, axis=1)[:, :kept]
    least.sort(axis=1)
    out = np.arange(low, high).astype(np.uint64) + np.uint64(1000 * least.shape[1])
    for i in range(least.shape[1]):
        out = out * _M1 + kmers[least[:, i]]
    return _mixed(out)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned share of labelled k-mers: matched / (a + b - matched); 0 where it can't reach *least*."""
    total = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    # A pair of this similarity has at most so many unmatched k-mers, which bounds the shift of a match.
    band = int(total * (1 - least) / (1 + least)) + 1
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < least * (total - len(at_a)):
        return 0.0
    run = at_b[np.argsort(at_a)]
    if (np.diff(run) > 0).all():
        matched = len(run)
    else:
        tails: list[int] = []
        for p in run.tolist():
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
        matched = len(tails)
    return matched / (total - matched)


def _sketched(documents: DataFrame, text_col: str, id_col: str, shingle: int, least: float, functions: int) -> DataFrame:
    """doc_id, node (16-byte text key), n (k-mers), sketch: a row for each document."""

    @lean(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, found = [], []
                for text in part.column(2).to_pylist():
                    kmers = labelled(text, shingle)
                    counts.append(len(kmers))
                    found.append(sketches(kmers, functions, least=least).view(np.int64) if len(kmers) else np.empty(0, np.int64))
                offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), values], ["doc_id", "node", "n", "sketch"])

    node = F.unhex(text_key(text_col))
    given = documents.select(F.col(id_col).cast("long").alias("doc_id"), node.alias("node"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, node binary, n long, sketch array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """node, leader, ok: whether the texts of each pair are similar."""

    @lean(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kmers = None, np.empty(0, np.uint64)
        for batch in batches:
            ok = []
            for leader, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if leader != last:
                    last, kmers = leader, labelled(b.as_py(), shingle)
                ok.append(similarity(labelled(a.as_py(), shingle), kmers, least) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["node", "leader", "ok"])

    both = pairs.join(texts, "node").select("node", "leader", F.col("text").alias("a"))
    both = both.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("b")), "leader")
    return both.select("node", "leader", "a", "b").mapInArrow(run, "node long, leader long, ok boolean")


def _linked(documents: DataFrame, nodes: DataFrame, text_col: str, shingle: int, least: float) -> DataFrame | None:
    """node, label: components of verified links; None without candidates. *nodes*: id, node, n, sketch.

    In here and in the result a node is its number, the id, which takes less of
    a shuffle than the key of a text. Sketches are bucketed by number alone;
    what else is needed of a node joins those that are in an open bucket.

    Candidates are pairs that share a bucket. A bucket is open while it holds
    nodes of several components. A few rounds compare open buckets with a
    leader each, in other random orders from round to round, which joins most
    components by few comparisons. Then all candidates of different components
    are compared, but those that their rarest k-mers rule out.
    """
    marks = F.transform("sketch", lambda x: (x.bitwiseAND(F.lit(0xFFFF).cast("long")) - 32768).cast("smallint"))
    rows = nodes.where("n > 0").select(F.explode("sketch").alias("key"), F.col("id").alias("node"), F.col("id").alias("label"))

    def joined(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The components after the pairs are verified."""
        good = written(_verified(pairs, texts, shingle, least), "tried").where("ok").select("node", "leader")
        if labels is None:
            return _components(good)
        return labels if good.isEmpty() else _components(_contracted(good, labels), labels)

    def left_of(buckets: DataFrame, labels: DataFrame) -> DataFrame:
        known = buckets.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return _opened(known.select(*buckets.columns))

    open_rows = written(_opened(rows), "numbers")
    about = nodes.select(F.col("id").alias("node"), F.col("node").alias("text_key"), "n", marks.alias("marks"))
    about = written(about.join(open_rows.select("node").distinct(), "node", "left_semi"), "candidates")
    count = about.count()
    if not count:
        return None
    open_rows = written(open_rows.join(about.drop("text_key"), "node"), "buckets")
    wanted = about.select("text_key", "node")
    wanted = F.broadcast(wanted) if count <= BROADCAST_KEYS else wanted
    keyed = documents.select(F.unhex(text_key(text_col)).alias("text_key"), F.col(text_col).alias("text")).join(wanted, "text_key")
    texts = written(keyed.select("node", "text").dropDuplicates(["node"]), "texts")  # equal texts but for one
    labels: DataFrame | None = None
    for turn in range(ROUNDS):
        order = F.xxhash64("node", F.pmod("key", F.lit(ORDERS)), F.lit(turn))
        heads = open_rows.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n", "label", "marks")).alias("head"))
        enough = (_agreeing("marks", "head.marks") >= AGREED) | (F.least("n", "head.n") <= SHORT)
        pairs = open_rows.join(written(heads, "heads"), "key").where(_apart("head", least) & enough).select("node", F.col("head.node").alias("leader")).distinct()
        labels = joined(pairs, labels)
        open_rows = written(left_of(open_rows, labels), "buckets")
        if open_rows.isEmpty():
            return labels
    nodes_left = written(open_rows.groupBy("node").agg(F.first("label").alias("label"), F.first("marks").alias("marks")), "open")
    return joined(_by_rarest(texts, nodes_left, shingle, least), labels)


def _opened(rows: DataFrame) -> DataFrame:
    """The rows of keys with two components at least. The keys are written first, so that Spark can split the join at a common one."""
    several = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    return rows.join(written(several.select("key"), "keys"), "key", "left_semi")


def _agreeing(marks: str, others: str) -> Column:
    """Sketches that two texts share."""
    return F.size(F.filter(F.zip_with(marks, others, lambda x, y: x == y), lambda x: x))


def _apart(other: str, least: float) -> Column:
    """Whether a row and another are of different components and of similar length."""
    return (F.col("label") != F.col(f"{other}.label")) & (F.least("n", f"{other}.n") >= least * F.greatest("n", f"{other}.n"))


def _by_rarest(texts: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """node, leader: pairs of different components that share a sketch and may be similar. *nodes*: node, label, marks.

    All k-mers have one order, the rarest first. Similar texts have *least*
    of the longer one's k-mers in common, so the first common one is among the
    first ``n - least * n + 1`` of each. From the place of this k-mer, and from
    the first few of both texts, follows how many they have in common at most.
    """

    @lean(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [labelled(text, shingle) for text in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(np.concatenate(found).view(np.int64))], ["node", "kmer"])

    kmers = written(texts.join(nodes.select("node"), "node", "left_semi").select("node", "text").mapInArrow(run, "node long, kmer long"), "kmers")
    seen = kmers.groupBy("kmer").agg(F.count("*").alias("seen")).where("seen > 1")
    # Rarity above, 48 bits of the k-mer below: one number whose order is that of all k-mers. Chance equals only add candidates.
    rarity = F.least(F.coalesce("seen", F.lit(1)), F.lit(0x7FFF)).cast("long")
    token = F.shiftleft(rarity, 48).bitwiseOR(F.col("kmer").bitwiseAND(F.lit((1 << 48) - 1).cast("long")))
    each = kmers.join(seen, "kmer", "left").select("node", token.alias("token")).groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    n = F.size("tokens")
    first = F.posexplode(F.slice("tokens", 1, n - F.ceil(n * least - SLACK).cast("int") + 1)).alias("at", "key")
    each = each.join(nodes, "node").select("node", "label", "marks", n.alias("n"), F.slice("tokens", 1, HEAD).alias("head"), first)
    rows = written(_opened(written(each.where(F.shiftright("key", 48) > 1), "rarest")), "shared")
    per = rows.groupBy("key", "label").agg(F.count("*").alias("members"))
    major = written(per.groupBy("key").agg(F.max_by("label", F.struct("members", "label")).alias("major")), "majors")
    rows = rows.join(major, "key")
    few = rows.where("label <> major").select("key", F.struct("node", "n", "label", "marks", "head", "at").alias("f"))
    once = (F.col("label") == F.col("major")) | (F.col("node") > F.col("f.node"))
    needed = least / (1 + least) * (F.col("n") + F.col("f.n"))
    common = F.array_intersect("head", "f.head")
    last = F.least(F.element_at("head", -1), F.element_at("f.head", -1))
    within = {side: F.size(F.filter(f"{side}head", lambda t: t <= last)) for side in ("", "f.")}
    rest = F.least(F.col("n") - within[""], F.col("f.n") - within["f."])
    is_first = (F.size(common) == 0) | (F.element_at(common, 1) == F.col("key"))
    placed = F.least(F.col("n") - F.col("at"), F.col("f.n") - F.col("f.at")) >= needed - SLACK
    reached = F.size(common) + rest >= needed - SLACK
    fits = once & _apart("f", least) & placed & is_first & reached & (_agreeing("marks", "f.marks") > 0)
    return rows.join(few, "key").where(fits).select("node", F.col("f.node").alias("leader")).distinct()


def _contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components: their ends replaced by the labels known so far."""
    a, b = labels.select("node", F.col("label").alias("la")), labels.select(F.col("node").alias("leader"), F.col("label").alias("lb"))
    rows = links.join(a, "node", "left").join(b, "leader", "left")
    return rows.select(F.coalesce("la", "node").alias("node"), F.coalesce("lb", "leader").alias("leader")).where("node <> leader").distinct()


def _components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, label: the least node of each connected component.

    With *known* labels, *links* are between those labels, and the result has
    the nodes of both.
    """
    edges = links.select("node", F.col("leader").alias("near"))
    edges = written(edges.unionByName(edges.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "edges")
    labels = edges.groupBy("node").agg(F.min("near").alias("label")).select("node", F.least("node", "label").alias("label"))
    labels = written(labels, "labels")
    while not edges.isEmpty():
        of = labels.select(F.col("node").alias("near"), F.col("label").alias("other"))
        least = edges.join(of, "near").groupBy("node").agg(F.min("other").alias("other"))
        step = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        # Pointer jumping: take the label of one's label.
        to = step.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = written(step.join(to, "label").select("node", "old", F.least("label", "jump").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            break
    if known is None:
        return labels
    moved = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = known.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(old.unionByName(labels.join(known.select("node"), "node", "left_anti")), "labels")


def _grouped(documents: DataFrame, id_col: str, text_col: str, shingle: int, least: float, functions: int) -> DataFrame:
    """doc_id, node (text key), label for each document; label is null for texts without any characters."""
    found = written(_sketched(documents, text_col, id_col, shingle, least, functions), "sketches")
    nodes = found.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # the numbers are fixed by writing them
    links = _linked(documents, nodes, text_col, shingle, least)
    nothing = F.unhex(text_key(F.lit("")))
    rows = found.select("doc_id", "node")
    if links is None:
        labelled_rows = rows.withColumn("label", F.col("node"))
    else:
        # A label of eight bytes can't equal a text key, which has sixteen.
        label = F.unhex(F.lpad(F.hex("label"), 16, "0")).alias("label")
        links = links.withColumnRenamed("node", "id").join(nodes.select("id", "node"), "id").select("node", label)
        labelled_rows = rows.join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return labelled_rows.withColumn("label", F.when(F.col("node") != nothing, F.col("label")))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """doc_id, class_id, class_size: a row for each row of *documents*.

    class_id is the least id of the class; class_size counts its rows. Equal
    texts share a class, and texts linked by *least* or more, directly or
    through others. Null and empty texts are alone each. A null id gets its
    class's least id, null where there is none. Other columns don't matter.
    """
    rows = written(_grouped(documents, id_col, text_col, shingle, least, functions), "grouped")
    classes = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    some = rows.where("label is not null").join(classes, "label").select("doc_id", "class_id", "class_size")
    alone = rows.where("label is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return some.unionByName(alone)


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """The rows of *documents* with one of each class: that of the least id, of the least text among equals.

    Rows without text are alone and stay. All columns stay as they are.
    """
    rows = written(_grouped(documents, id_col, text_col, shingle, least, functions).where("label is not null"), "grouped")
    each = rows.groupBy("label", "doc_id", "node").agg(F.count("*").alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "node")
    first = each.groupBy("label").agg(F.min(order).alias("first"))
    each = written(each.join(first, "label").withColumn("stays", order.eqNullSafe(F.col("first"))).where("not stays or times > 1").select("doc_id", "node", "stays"), "decided")
    id_name, node_name, stays = fresh(documents, "kept_id"), fresh(documents, "kept_node"), fresh(documents, "kept_stays")
    few = each.count() <= BROADCAST_KEYS
    decided = each.select(F.col("doc_id").alias(f"{id_name}_"), F.col("node").alias(f"{node_name}_"), F.col("stays").alias(stays))
    decided = F.broadcast(decided) if few else decided
    keyed = documents.withColumns({id_name: F.col(id_col).cast("long"), node_name: F.unhex(text_key(documents[text_col]))})
    joined = keyed.join(decided, F.col(id_name).eqNullSafe(F.col(f"{id_name}_")) & (F.col(node_name) == F.col(f"{node_name}_")), "left")
    plain = joined.where(F.col(stays).isNull())
    repeated = joined.where(F.col(stays)).dropDuplicates([id_name, node_name])
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return plain.select(*columns).unionByName(repeated.select(*columns))
