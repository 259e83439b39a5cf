"""Normalising what providers return about a document: points with evidence, atoms with points.

Nothing is attributed by position or guess. What lacks an explicit, known
attribution goes, and how many went for which reason is counted by the same
pass (:meth:`DataFrame.observe`): the counts are there once an action has run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kunits.operators.quotes import reconcile

KEPT, NO_ATTRIBUTION, MISMATCH = "kept", "no_point_attribution", "point_id_mismatch"


def _ids(column: str, columns: list[str]) -> F.Column:
    """Ids of an array column without nulls, blanks and repeats; none where the column is missing."""
    none = F.array().cast("array<string>")
    if column not in columns:
        return none
    trimmed = F.transform(F.coalesce(F.col(column), none), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def normalise_atoms(atoms: DataFrame, points: DataFrame, evidence: DataFrame, doc: str = "source_document_id", name: str = "atoms") -> tuple[DataFrame, Observation]:
    """Atoms with the points of their document that they name, and the first one's evidence; and the counts.

    *atoms*: doc, atom_id, content_point_ids, or point_ids where the ids stand
    outside of the content; *points*: doc, point_id, evidence_ids; *evidence*:
    doc, evidence_id, quote, block_id. Adds point_ids (known ones, in the
    atom's order), evidence_quote and evidence_block: those of the first
    known point's first known evidence. Counted: atoms, kept,
    dropped_no_point_attribution, dropped_point_id_mismatch, unknown_point_ids.
    Atom ids are unique in a document; nulls name nothing.
    """
    rows = atoms.withColumn("_asked", F.when(F.size(_ids("content_point_ids", atoms.columns)) > 0, _ids("content_point_ids", atoms.columns)).otherwise(_ids("point_ids", atoms.columns)))
    first = points.select(F.col(doc).alias("_doc"), F.trim("point_id").alias("_point"), F.posexplode_outer("evidence_ids").alias("_at", "_evidence"))
    said = evidence.select(F.col(doc).alias("_doc"), F.trim("evidence_id").alias("_evidence"), "quote", "block_id").dropDuplicates(["_doc", "_evidence"])
    known = first.join(said, ["_doc", "_evidence"], "left").groupBy("_doc", "_point").agg(F.min_by(F.struct("quote", "block_id"), F.when(F.col("block_id").isNotNull() | F.col("quote").isNotNull(), F.col("_at"))).alias("_said"))
    asked = rows.select(F.col(doc).alias("_doc"), F.col("atom_id").alias("_atom"), F.posexplode("_asked").alias("_nth", "_point"))
    named = asked.join(known.withColumn("_known", F.lit(True)), ["_doc", "_point"], "left").where("_known")
    by_atom = named.groupBy("_doc", "_atom").agg(F.array_sort(F.collect_list(F.struct("_nth", "_point", "_said"))).alias("_named"))  # an atom's own ids
    joined = rows.join(by_atom, F.col(doc).eqNullSafe(F.col("_doc")) & F.col("atom_id").eqNullSafe(F.col("_atom")), "left")
    found = F.coalesce(F.size("_named"), F.lit(0))
    outcome = F.when(F.size("_asked") == 0, NO_ATTRIBUTION).when(F.col("_named").isNull(), MISMATCH).otherwise(KEPT)
    judged = joined.withColumns({"_outcome": outcome, "_unknown": F.size("_asked") - F.when(F.col("_named").isNull(), 0).otherwise(found)})
    counts = Observation(name)
    n = lambda reason: F.count_if(F.col("_outcome") == reason)
    seen = judged.observe(counts, F.count("*").alias("atoms"), n(KEPT).alias("kept"), n(NO_ATTRIBUTION).alias("dropped_no_point_attribution"), n(MISMATCH).alias("dropped_point_id_mismatch"), F.coalesce(F.sum("_unknown"), F.lit(0)).alias("unknown_point_ids"))
    held = [c for c in atoms.columns if c not in ("point_ids", "evidence_quote", "evidence_block")]
    shown = F.get(F.filter("_named", lambda x: x["_said"].isNotNull()), 0)["_said"]
    out = seen.where(F.col("_outcome") == KEPT).select(*held, F.transform("_named", lambda x: x["_point"]).alias("point_ids"), shown["quote"].alias("evidence_quote"), shown["block_id"].alias("evidence_block"))
    return out, counts


def normalise_summary(points: DataFrame, evidence: DataFrame, blocks: DataFrame, doc: str = "source_document_id", name: str = "summary") -> tuple[DataFrame, DataFrame, Observation, Observation]:
    """(points, evidence, counts of points, counts of evidence): evidence must stand in a block, points must have evidence.

    *evidence*: doc, evidence_id, quote, block_id (a hint); its quote is looked
    for in the document's eligible *blocks* (:func:`quotes.reconcile`), and
    what it says of its place is replaced by where it was found. All
    evidence comes back with ``provenance`` (status, block_id), points with
    the ids of resolved evidence; points without any are dropped. Counted:
    points, kept, dropped_points, dropped_evidence_ids; evidence, resolved,
    quote_not_found, ambiguous_quote.
    """
    key = F.concat_ws("\x1f", F.col(doc).cast("string"), F.trim("evidence_id"))
    given = evidence.withColumn("_key", key).dropDuplicates(["_key"])
    placed = reconcile(given.select(doc, F.col("_key").alias("quote_id"), "quote", F.col("block_id").alias("hint")), blocks, doc)
    status = placed.select(F.col("quote_id").alias("_key"), F.struct("status", "block_id").alias("provenance"))
    counted = Observation(f"{name}-evidence")
    n = lambda s: F.count_if(F.col("provenance.status") == s).alias(s)
    whole = given.join(status, "_key").observe(counted, F.count("*").alias("evidence"), n("resolved"), n("quote_not_found"), n("ambiguous_quote"))
    good = status.where("provenance.status = 'resolved'").select("_key")
    asked = points.select(F.col(doc).alias("_doc"), F.trim("point_id").alias("_point"), F.posexplode(_ids("evidence_ids", points.columns)).alias("_nth", "_id"))
    held = asked.withColumn("_key", F.concat_ws("\x1f", F.col("_doc").cast("string"), "_id")).join(good, "_key", "left_semi")
    by_point = held.groupBy("_doc", "_point").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_id"))), lambda x: x["_id"]).alias("_held"))  # a point's own ids
    joined = points.join(by_point, F.col(doc).eqNullSafe(F.col("_doc")) & F.trim("point_id").eqNullSafe(F.col("_point")), "left")
    lost = F.size(_ids("evidence_ids", points.columns)) - F.coalesce(F.when(F.col("_held").isNotNull(), F.size("_held")), F.lit(0))
    counts = Observation(f"{name}-points")
    seen = joined.observe(counts, F.count("*").alias("points"), F.count_if(F.col("_held").isNotNull()).alias("kept"), F.count_if(F.col("_held").isNull()).alias("dropped_points"), F.coalesce(F.sum(lost), F.lit(0)).alias("dropped_evidence_ids"))
    kept = seen.where("_held is not null").select(*(c for c in points.columns if c != "evidence_ids"), F.col("_held").alias("evidence_ids"))
    return kept, whole.drop("_key"), counts, counted
