"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on a bounded sample of labelled rows; every path from a root
to a node is a conjunctive rule. A lasso logistic regression over the rules
leaves few with a weight, and these are compiled into one Spark column
expression, so scoring is a projection inside the scan's stage.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that training takes at most (those of the least hash); scoring takes all rows.
SAMPLE = 20_000
FOLDS, CUT = 5, 0.3
TREES, DEPTH, PENALTY, SEED = 24, 4, 0.002, 7


#: Statistics that are counted in a text, and shares: (what is counted, among what).
COUNTS = {
    "upper": r"\p{Lu}",
    "marks": r"[^\p{L}\p{N}\s.,;:'\"-]",
    "stops": r"[.,;:](?=\s|$)",
    "digits": r"[0-9]",
    "bars": r"\|",
    "again": r"(?<!\S)(\S++)(?=\s\1(?!\S))",
    "marked_ends": r"[#$%&*!@]{2,}(?=\s|$)",
    "lines": r"\n",
    "words": r"\S+",
}
SHARES = {
    "chars_per_word": ("chars", "words"), "upper_share": ("upper", "chars"), "mark_share": ("marks", "chars"), "stop_share": ("stops", "words"), "digit_share": ("digits", "chars"),
    "bar_share": ("bars", "words"), "again_share": ("again", "words"), "marked_end_share": ("marked_ends", "words"), "line_share": ("lines", "words"),
}
NAMES = ("log_chars", *SHARES)


def counts(text: Column, names: Iterable[str] = NAMES) -> dict[str, Column]:
    """What is counted in a text for the statistics *names*; all 0 for a null or empty text."""
    t = F.coalesce(text, F.lit(""))
    wanted = {"chars"} | {c for n in names for c in SHARES.get(n, ())}
    return {"chars": F.char_length(t)} | {c: F.regexp_count(t, F.lit(pattern)) for c, pattern in COUNTS.items() if c in wanted}


def features(of: Mapping[str, Column], names: Iterable[str] = NAMES) -> dict[str, Column]:
    """The statistics *names* from the counts of a text; shares of nothing are 0."""

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(of[part].cast("double"), of[whole].cast("double")), F.lit(0.0))

    return {n: share(*SHARES[n]) if n in SHARES else F.log1p(of["chars"].cast("double")) for n in names}


@dataclass(frozen=True)
class Rule:
    """All conditions must hold: (feature, whether at most, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, of: dict[str, Column]) -> Column:
        whole = F.lit(True)
        for name, at_most, threshold in self.conditions:
            whole = whole & (of[name] <= threshold if at_most else of[name] > threshold)
        return whole


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weighted: tuple[tuple[float, Rule], ...]

    def names(self) -> list[str]:
        """The statistics that the rules read."""
        return sorted({name for _, rule in self.weighted for name, _, _ in rule.conditions})

    def score(self, of: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.weighted:
            total = total + F.when(rule.column(of), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(described: str, names: list[str]) -> list[Rule]:
    """The rules of a tree, from its description: one for each node but the root."""
    found: list[Rule] = []
    path: list[tuple[str, bool, float]] = []
    for line in described.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1]) - 3  # the description indents the root's branches by three
        del path[depth:]
        path.append((names[int(m[3])], m[4] == "<=", float(m[5])))
        found.append(Rule(tuple(sorted(path))))
    return found


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """Fit on labelled rows outside the held-out fold, at most *sample* of them.

    Rows with a null id or label don't count; of several labels of one id the
    largest counts, of several documents of one id that of the least
    statistics. Without rows of both labels the model is a constant: the
    share of label 1, or one half without any label.
    """
    spark = documents.sparkSession
    ids = F.col(id_col).cast("long")
    known = (
        labels.select(ids.alias("id"), F.col(label_col).cast("double").alias("label"))
        .where("id is not null and label is not null")
        .where(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    given = documents.select(ids.alias("id"), F.col(text_col).alias("text")).where("id is not null").join(F.broadcast(known), "id")  # at most *sample* rows
    names = list(NAMES)
    counted = given.select("id", "label", *(c.alias(n) for n, c in counts(F.col("text")).items()))
    of = features({c: F.col(c) for c in counted.columns})
    one = counted.select("id", F.struct("label", *(of[n].alias(n) for n in names)).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    rows = sorted(one.select("row.*").collect())  # at most *sample* rows, one an id
    share = sum(r[0] for r in rows) / len(rows) if rows else 0.5
    if share in (0.0, 1.0) or not rows:
        inside = min(max(share, 0.01), 0.99)
        return RuleModel(math.log(inside / (1 - inside)), ())
    data = VectorAssembler(inputCols=names, outputCol="features").transform(spark.createDataFrame(rows, "label double, " + ", ".join(f"{n} double" for n in names)).coalesce(2))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=max(2, len(rows) // 500), featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(data)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString, names)}, key=lambda r: (len(r.conditions), r.conditions))
    at = {n: F.col(n) for n in names}
    fired = data.select("label", F.array(*(r.column(at).cast("double") for r in rules)).alias("fired"))
    from pyspark.ml.functions import array_to_vector

    fit = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60, featuresCol="fired_vector").fit(fired.select("label", array_to_vector("fired").alias("fired_vector")))
    weighted = tuple((float(w), r) for w, r in zip(fit.coefficients.toArray(), rules, strict=True) if abs(w) > 1e-6)
    return RuleModel(float(fit.intercept), weighted)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def classify(documents: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of *documents*.

    Native columns only, no shuffle. Null texts score as empty ones; a null id
    isn't held out; repeated rows are scored each; other columns don't matter.
    """
    of = counts(F.col(text_col), model.names())
    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(n) for n, c in of.items()))
    score = model.score(features({n: F.col(n) for n in of}, model.names()))
    return base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(documents: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of *documents* that the model predicts as good, with their own columns.

    The counts are bound once, in a struct that the rules read: a filter over
    plain columns would be pushed below them and repeat each count in each rule.
    """
    of = counts(documents[text_col], model.names())
    bound = F.array(F.struct(*(c.alias(n) for n, c in of.items())))
    return documents.where(F.exists(bound, lambda s: model.score(features({n: s[n] for n in of}, model.names())) >= CUT))
