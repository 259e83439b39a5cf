"""Interaction audit of five document filters, over all orders in which they may run.

Each document is reduced to five failure flags. Documents are counted by part
and flags, and a cube over the flags and the part gives, for every subset of
filters, how many documents survive it: the grouping-set rows whose selected
flags are all false. A step of an order goes from one subset to the next, so
each step is a join of two subsets.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kunits.llm.common import written

LETTERS = "ABCDE"
#: Least words, least percentage of distinct words, largest percentage of capitals, marks that a text mustn't hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
SUBSETS = 2 ** len(LETTERS)


def text_failures(text: Column) -> dict[str, Column]:
    """Failure flags A to D of a text (null: empty); E needs the other documents."""
    t = F.coalesce(text, F.lit(""))
    inside = F.btrim(t, F.lit(_SPACE))
    words = F.split(inside, _SPACES)  # of an empty text: one empty word
    empty = (inside == "").cast("int")
    n, distinct = F.size(words) - empty, F.size(F.array_distinct(words)) - empty
    return {
        "A": n < LEAST_WORDS,
        "B": F.lit(100) * distinct.cast("long") < F.lit(LEAST_DISTINCT) * n.cast("long"),
        "C": F.lit(100) * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > F.lit(MOST_CAPITALS) * F.char_length(t).cast("long"),
        "D": t.rlike(MARKS),
    }


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: one row for each id; of several labels of one id any counts."""
    yes = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias({"quality": "good"}.get(c, c))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    return known.groupBy("doc_id").agg(yes("quality"), yes("toxic"))


def failure_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, n, n_good, n_toxic: documents counted by part and failure flags.

    Equal texts are found by their SHA-256. Groups of copies are combined
    before they are shuffled: by text, id and part first, then by text, part
    and labels, of which the least id, its rows and all rows suffice; so no
    task meets a group's documents one by one. A null id is neither smaller
    than another nor larger.
    """
    text = F.col("text")
    base = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("text_key"),
        *(c.alias(k) for k, c in text_failures(text).items()),
    )
    flags = list("ABCD")
    once = base.groupBy("text_key", "doc_id", "part", *flags).agg(F.count("*").alias("n"))
    known = once.join(labelled(labels), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    cells = known.groupBy("text_key", "part", "good", "toxic", *flags).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"), least)
    first = F.min("least.doc_id").over(Window.partitionBy("text_key"))  # a few rows a text: parts by labels
    copies = (F.col("with_id") - F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)).alias("copies")
    split = cells.select("part", "good", "toxic", *flags, "n", copies)
    both = split.select("part", "good", "toxic", *flags, F.inline(F.array(F.struct(F.lit(False).alias("E"), (F.col("n") - F.col("copies")).alias("m")), F.struct(F.lit(True).alias("E"), F.col("copies").alias("m")))))
    return both.where("m > 0").groupBy("part", *LETTERS).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("good")).alias("n_good"), F.sum(F.col("m") * F.col("toxic")).alias("n_toxic"))


def survivors(counted: DataFrame) -> DataFrame:
    """part, subset (bit 0 is A), kept, good, toxic: what each subset of filters leaves of each part, zeros included."""
    selected = [(1 - F.grouping(c)) for c in LETTERS]
    cube = counted.cube(*LETTERS, "part").agg(
        F.grouping("part").alias("all_parts"),
        reduce(lambda a, b: a + b, (s.cast("int") * F.lit(1 << i) for i, s in enumerate(selected))).alias("subset"),
        F.sum("n").alias("kept"), F.sum("n_good").alias("good"), F.sum("n_toxic").alias("toxic"),
    )
    # A flag that a grouping set leaves out is null: whoever failed it is counted.
    passed = reduce(lambda a, b: a & b, (~F.coalesce(F.col(c), F.lit(False)) for c in LETTERS))
    found = cube.where((F.col("all_parts") == 0) & passed).select("part", "subset", "kept", "good", "toxic")
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(SUBSETS - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").na.fill(0, ["kept", "good", "toxic"])


def steps() -> list[tuple[str, int, str, int, int]]:
    """(order, step, filter, subset before it, subset after it) of all orders."""
    found = []
    for order in permutations(LETTERS):
        before = 0
        for k, letter in enumerate(order, 1):
            after = before | 1 << LETTERS.index(letter)
            found.append(("".join(order), k, letter, before, after))
            before = after
    return found


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order and step. Null and empty texts fail A alone
    (and E, where they repeat); repeated rows are documents each, and the same
    id twice is no copy; a null or empty lang is the part of the empty string;
    ids without labels are neither good nor toxic; no documents give no rows;
    other columns of the tables don't matter.
    """
    counted = written(failure_counts(documents, labels), "failure-counts")  # at most 32 rows a part
    left = written(survivors(counted), "subset-survivors")
    walk = F.broadcast(documents.sparkSession.createDataFrame(steps(), "filter_order string, step int, filter string, before int, after int"))  # 600 rows always
    at = lambda name: left.select("part", F.col("subset").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("kept", "good", "toxic")))
    pairs = at("before").join(walk, "before").join(at("after"), ["part", "after"])
    lost = lambda c: F.col(f"{c}_before") - F.col(f"{c}_after")
    stepped = pairs.select("part", "filter_order", "step", "filter", F.col("kept_after").alias("kept"), lost("kept").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    same = Window.partitionBy("part", "filter")  # one row for each order
    last = len(LETTERS)
    fails = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(same)  # as the first, a filter removes all that fail it
    alone = F.max(F.when(F.col("step") == last, F.col("removed"))).over(same)  # as the last, those that fail nothing else
    return stepped.select(
        "part", "filter_order", "step", "kept", "removed",
        (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(same).alias("shapley"),
    )
