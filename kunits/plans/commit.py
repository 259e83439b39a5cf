"""Commit and verification: versioned writes, set equality, verified facts, audits."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Collection
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.functions.text import front_value, has_source
from kunits.schema import KNOWLEDGE_KINDS, LIBRARIES, PRODUCTION

STORED_NAMES = ("path", "record_id", "record_kind", "owner_source_id", "content", "content_hash")
STORED = ", ".join(f"{name} string" for name in STORED_NAMES)
MANIFEST = "version int, transaction_id string, run_id string, task_id string, status string, created_at double, records long"


class CommitError(RuntimeError):
    """A commit that left the visible version as it was; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, value: rows of one set only, duplicates dropped; empty iff the sets are equal."""
    a, b = a.select(F.col(a.columns[0]).alias("value")).distinct(), b.select(F.col(b.columns[0]).alias("value")).distinct()
    return a.exceptAll(b).select(F.lit("left").alias("side"), "value").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "value"))


def verify(actions: DataFrame, files: DataFrame) -> DataFrame:
    """Actions with what reading back shows: disposition, bytes and reason (null if verified).

    reason: missing_file, empty_file, hash_mismatch or identity_or_source_mismatch.
    """
    rows = actions.join(files.select("path", F.col("content").alias("seen")), "path", "left")
    knowledge = F.col("record_kind").isin(*KNOWLEDGE_KINDS)
    same = (front_value(F.col("seen"), "record_id") == F.col("record_id")) & (front_value(F.col("seen"), "record_kind") == F.col("record_kind")) & F.col("path").endswith(".md")
    owned = ~knowledge | has_source(F.col("seen"), F.coalesce("owner_source_id", F.lit("\x00")))
    reason = F.when(F.col("seen").isNull(), "missing_file").when(F.trim("seen") == "", "empty_file").when(~same | ~owned, "identity_or_source_mismatch").when(F.sha2("seen", 256) != F.col("content_hash"), "hash_mismatch")
    return rows.withColumns({"reason": reason, "disposition": F.when(F.col("action") == "noop", "unchanged").otherwise(F.col("action")), "bytes": F.octet_length("seen"), "knowledge_record": knowledge}).drop("seen")


def commit_counts(verified: DataFrame) -> DataFrame:
    """One row of ten counts and the bytes written."""
    d, kind, know = F.col("disposition"), F.col("record_kind"), F.col("knowledge_record")
    n = lambda cond, name: F.count_if(cond).alias(name)
    return verified.where("reason is null").agg(
        n(d == "create", "created"), n(d.contains("update"), "updated"), n(d == "unchanged", "unchanged"), n(d.contains("move"), "moved"), n(kind == "source_document", "source_records"), n(kind == "project", "project_records"),
        n(know, "knowledge_records"), n(know & (d == "create"), "knowledge_created"), n(know & d.contains("update"), "knowledge_updated"), n(know & (d == "unchanged"), "knowledge_unchanged"),
        F.coalesce(F.sum(F.when(d != "unchanged", F.col("bytes"))), F.lit(0)).alias("bytes_written"),
    )


@dataclass(frozen=True)
class Lease:
    """The right to write a store until a time; its number only grows, so a later lease fences an earlier one off."""

    number: int
    holder: str
    until: float


class VersionedStore:
    """Records as versions over buckets of ids, with pointers; a version shows only once its pointer is written.

    A commit writes the buckets that its records fall in, and no others, to a
    folder of its own (``root/data/<transaction>``); ``root/versions/<n>``
    lists for each bucket the folder that holds it. ``root/manifest`` has a
    row for each transaction. ``root/pointers/<i>`` names the version shown by
    the i-th move; the last one that is whole holds, so a crash while one is
    written shows what was shown before.

    Writers hold a lease with an end (``root/leases/<n>``). Whoever finds it
    run out takes the next number, and a pointer is only made under the last
    number. Versions, leases and pointers are created, never replaced: of two
    writers that still meet at one pointer the later is refused, and what it
    wrote is never shown. Paths may be of any file system that Spark reads
    and writes, if creating a file that exists fails there.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, lease_seconds: float = 1800, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.buckets, self.lease_seconds, self.clock = spark, root.rstrip("/"), buckets, lease_seconds, clock

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []

    def _numbers(self, folder: str) -> list[int]:
        """Numbers of the folder's files, the last one first."""
        return sorted((int(name) for name in self._names(folder) if name.isdigit()), reverse=True)

    def _create(self, name: str, value: dict, taken: CommitError) -> None:
        """Write a small file that nobody else may have made; else *taken* is raised."""
        fs, path = self._path(name)
        try:
            out = fs.create(path, False)
        except Py4JJavaError as error:
            if fs.exists(path):
                raise taken from error
            raise
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _value(self, name: str) -> dict | None:
        """What a small file says; null where a crash cut it off."""
        lines = self.spark.read.text(f"{self.root}/{name}").collect()  # one line
        try:
            return json.loads("".join(r.value for r in lines))
        except ValueError:
            return None

    # Leases

    def lease(self) -> Lease | None:
        """The last lease, also one that has run out; one cut off by a crash counts as run out."""
        for number in self._numbers("leases")[:1]:
            said = self._value(f"leases/{number}") or {"holder": "", "until": 0.0}
            released = f"{number}.released" in self._names("leases")
            return Lease(number, said["holder"], 0.0 if released else said["until"])
        return None

    def acquire(self, holder: str) -> Lease:
        """Take the lease, or extend one's own; refused while another's holds."""
        last = self.lease()
        if last and last.until > self.clock() and last.holder != holder:
            raise CommitError("STORE_LOCKED", f"{last.holder} writes until {last.until:.0f}")
        number = last.number + 1 if last else 1
        mine = Lease(number, holder, self.clock() + self.lease_seconds)
        self._create(f"leases/{number}", {"holder": holder, "until": mine.until}, CommitError("STORE_LOCKED", f"lease {number} went to another writer"))
        return mine

    def release(self, lease: Lease) -> None:
        self._create(f"leases/{lease.number}.released", {}, CommitError("STORE_LOCKED", "released already"))

    def _fence(self, lease: Lease) -> None:
        last = self.lease()
        if last is None or last.number != lease.number:
            raise CommitError("LEASE_LOST", f"lease {lease.number} was followed by {last.number if last else 0}")

    # Versions

    def version(self) -> int:
        """The visible version, 0 before the first."""
        for move in self._numbers("pointers"):
            if said := self._value(f"pointers/{move}"):
                return said["version"]
        return 0

    def _point(self, version: int, move: int) -> None:
        """Show a version by pointer *move*, which nobody else may have made."""
        self._create(f"pointers/{move}", {"version": version}, CommitError("OPTIMISTIC_VERSION_MISMATCH", f"pointer {move} was made by another commit"))

    def folders(self, version: int) -> dict[int, str]:
        """Bucket to folder of a version; buckets without records are missing."""
        said = self._value(f"versions/{version}") if version else {}
        if said is None:
            raise CommitError("VERSION_UNREADABLE", f"version {version} has no list of folders")
        return {int(bucket): folder for bucket, folder in said.items()}

    def read(self, version: int | None = None, buckets: Collection[int] | None = None) -> DataFrame | None:
        """Records of a version (the visible one), of some buckets or all; null before the first."""
        version = self.version() if version is None else version
        if not version:
            return None
        asked = [f"{self.root}/data/{folder}/bucket={bucket}" for bucket, folder in self.folders(version).items() if buckets is None or bucket in buckets]
        rows = self.spark.read.schema(STORED)
        return rows.parquet(*asked) if asked else self.spark.createDataFrame([], STORED)

    def _written(self, rows: DataFrame, transaction: str) -> set[int]:
        """Write rows by bucket, a file for each; which buckets hold any."""
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{transaction}")
        return {int(name.removeprefix("bucket=")) for name in self._names(f"data/{transaction}") if name.startswith("bucket=")}

    def commit(self, actions: DataFrame, run_id: str, task_id: str, blocked: bool = False, expected: int | None = None, lease: Lease | None = None) -> DataFrame:
        """Write the changed buckets as the next version, read them back, verify, then show it; returns its verified rows.

        planned = committed = visible must hold for knowledge records. Any
        failure leaves the visible version as it was. *expected* refuses the
        commit if another has come between. Without a *lease* one is taken for
        this commit.
        """
        if not run_id or not task_id:
            raise CommitError("CURRENT_RUN_REQUIRED", "a commit names its run and its task")
        if blocked:
            raise CommitError("PLAN_BLOCKED", "the plan holds conflicts or open items")
        held = lease or self.acquire(f"{run_id}/{task_id}/{uuid.uuid4().hex[:8]}")
        try:
            return self._commit(actions, run_id, task_id, expected, held)
        finally:
            if lease is None:
                self.release(held)

    def _commit(self, actions: DataFrame, run_id: str, task_id: str, expected: int | None, lease: Lease) -> DataFrame:
        move = max(self._numbers("pointers"), default=0) + 1
        now = self.version()
        if expected is not None and expected != now:
            raise CommitError("OPTIMISTIC_VERSION_MISMATCH", f"expected version {expected}, found {now}")
        transaction = f"txn-{uuid.uuid4().hex[:24]}"
        bucket = F.pmod(F.xxhash64("record_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = {r.bucket for r in actions.select(bucket).distinct().collect()}  # no more than there are buckets
        rows = actions.select(*STORED_NAMES)
        old = self.read(now, touched)
        if old is not None:
            rows = rows.unionByName(old.join(actions.select("record_id").distinct(), "record_id", "left_anti"))
        held = self._written(rows.select(*STORED_NAMES, bucket), transaction)
        folders = {b: f for b, f in self.folders(now).items() if b not in touched} | dict.fromkeys(held, transaction)
        version = max(self._numbers("versions"), default=0) + 1
        self._create(f"versions/{version}", {str(b): f for b, f in sorted(folders.items())}, CommitError("OPTIMISTIC_VERSION_MISMATCH", f"version {version} was made by another commit"))
        checked = verify(actions, self.read(version, touched).select("path", "content"))
        knowledge = F.col("record_kind").isin(*KNOWLEDGE_KINDS)
        planned, visible = actions.where(knowledge).select("path"), checked.where(knowledge & F.col("reason").isNull()).select("path")
        bad = checked.where("reason is not null").limit(1).count() or set_difference(planned, visible).limit(1).count()
        self._log(version, transaction, run_id, task_id, "failed" if bad else "committed", self.read(version).count())
        if bad:
            raise CommitError("STRUCTURED_WRITE_NOT_PERSISTED", "what was read back isn't what was planned")
        self._fence(lease)
        self._point(version, move)
        return checked.withColumns({"transaction_id": F.lit(transaction), "run_id": F.lit(run_id), "state": F.lit("visible_verified")})

    def rollback(self, version: int, expected_hash: str | None = None) -> None:
        """Show an earlier version again, if the visible one is still as committed."""
        lease = self.acquire(f"rollback/{uuid.uuid4().hex[:8]}")
        try:
            move = max(self._numbers("pointers"), default=0) + 1
            if expected_hash is not None and self.fingerprint() != expected_hash:
                raise CommitError("CHANGED_SINCE", "the store was changed since that commit")
            self.folders(version)
            self._fence(lease)
            self._point(version, move)
        finally:
            self.release(lease)

    def fingerprint(self, version: int | None = None) -> str:
        """Order-free hash of a version's ids and contents."""
        rows = self.read(version)
        return "" if rows is None else str(rows.agg(F.sum(F.xxhash64("record_id", "path", "content").cast("decimal(38,0)"))).head()[0])

    def unreferenced(self, keep: int = 2) -> list[str]:
        """Folders of data that none of the last *keep* shown versions reads: failed commits and old versions."""
        shown = list(dict.fromkeys(said["version"] for move in self._numbers("pointers") if (said := self._value(f"pointers/{move}"))))[:keep]
        used = {folder for version in shown for folder in self.folders(version).values()}
        return sorted(set(self._names("data")) - used)

    def _log(self, *row) -> None:
        version, transaction, run, task, status, records = row
        self.spark.createDataFrame([(version, transaction, run, task, status, self.clock(), records)], MANIFEST).write.mode("append").parquet(f"{self.root}/manifest")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")


def verified_records(rows: DataFrame) -> DataFrame:
    """Rows that prove a stored record of the task's own run."""
    path = normal_path(F.col("final_path"))
    return rows.where(
        (F.col("state") == "visible_verified") & (F.coalesce("record_id", F.lit("")) != "") & F.col("record_kind").isin(*KNOWLEDGE_KINDS) & (path != "") & (F.col("run_id") == F.col("task_run_id"))
        & (F.col("vault_file_type") == "markdown") & F.col("target_library").isin(*LIBRARIES) & F.col("content_hash").rlike("^[a-f0-9]{64}$") & (F.coalesce("transaction_id", F.lit("")) != "")
    )


def normal_path(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(column, F.lit("")), r"\\", "/"), "^/+|/+$", "")


def verified_facts(rows: DataFrame, order: str = "nth") -> DataFrame:
    """task_id, count, paths: distinct final paths of verified records; the last row of a path counts."""
    kept = verified_records(rows).withColumn("path", normal_path(F.col("final_path")))
    kept = kept.withColumn("_n", F.row_number().over(W.partitionBy("task_id", "path").orderBy(F.desc(order)))).where("_n = 1")
    return kept.groupBy("task_id").agg(F.count("*").alias("verified"), F.array_sort(F.collect_list("path")).alias("paths"))


def audit(tasks: DataFrame, facts: DataFrame) -> DataFrame:
    """task_id, errors: what a task claims beyond its verified records (five kinds of drift)."""
    rows = tasks.join(facts, "task_id", "left").withColumns({"verified": F.coalesce("verified", F.lit(0)), "paths": F.coalesce("paths", F.array().cast("array<string>"))})
    claims = F.col("status").isin("written", "success", "archived") | F.col("terminal_outcome").eqNullSafe("completed_with_output")
    drift = lambda c, name: F.when(F.coalesce(F.col(c), F.lit(0)) != F.col("verified"), name)
    errors = F.array_compact(F.array(
        F.when(claims & (F.col("verified") == 0), "success_without_visible_verified_record"), drift("count_verified", "verified_count_drift"), drift("count_written", "written_count_drift"), drift("count_knowledge", "knowledge_count_drift"),
        F.when(F.array_sort(F.coalesce("output_paths", F.array().cast("array<string>"))) != F.col("paths"), "output_paths_drift"),
    ))
    return rows.select("task_id", "verified", errors.alias("errors"), (F.size(errors) == 0).alias("ok"))


def apply_facts(tasks: DataFrame, facts: DataFrame) -> DataFrame:
    """Tasks with counts and paths from their facts; stale success becomes verification_required."""
    rows = tasks.drop("output_paths", "count_verified", "count_written", "count_knowledge").join(facts, "task_id", "left")
    n = F.coalesce("verified", F.lit(0))
    stale = F.col("status").isin("written", "success", "archived") & (n == 0)
    rows = rows.withColumns({"count_verified": n, "count_written": n, "count_knowledge": n, "output_paths": F.coalesce("paths", F.array().cast("array<string>")), "status": F.when(stale, "verification_required").otherwise(F.col("status")), "terminal_outcome": F.when(stale, F.lit(None)).otherwise(F.col("terminal_outcome"))})
    return rows.drop("verified", "paths")


def manifest_valid(records: DataFrame, tasks: DataFrame, planned: DataFrame, committed: DataFrame) -> DataFrame:
    """task_id, valid: the manifest of the current run proves the task.

    The three path sets are equal and not empty and every record is of the
    run, visible, Markdown, under its library's root and hashed.
    """
    sets = lambda df, name: df.groupBy("task_id", "run_id").agg(F.array_sort(F.collect_set("path")).alias(name))
    good = (F.col("state") == "visible_verified") & F.lower("path").endswith(".md") & F.col("target_library").isin(*LIBRARIES) & F.col("path").startswith(F.concat("target_root", F.lit("/"))) & F.col("content_hash").rlike("^[a-f0-9]{64}$")
    seen = records.groupBy("task_id", "run_id").agg(F.every(good).alias("good"), F.array_sort(F.collect_set("path")).alias("visible"), F.count("*").alias("n"))
    rows = tasks.select("task_id", "run_id").join(seen, ["task_id", "run_id"], "left").join(sets(planned, "planned"), ["task_id", "run_id"], "left").join(sets(committed, "committed"), ["task_id", "run_id"], "left")
    ok = F.col("good") & (F.size("planned") > 0) & (F.col("planned") == F.col("committed")) & (F.col("planned") == F.col("visible")) & (F.col("n") == F.size("visible"))
    return rows.select("task_id", F.coalesce(ok, F.lit(False)).alias("valid"))


def production_transition(state: Column, to: Column, manifest_ok: Column, percent: Column) -> Column:
    """Why a task may not go to a production state; null if it may."""
    legal = F.lit(False)
    for a, b in PRODUCTION.items():
        legal = legal | ((state == a) & to.isin(a, *b))
    return F.when(~F.coalesce(to.isin(*PRODUCTION), F.lit(False)), "UNKNOWN_STATE").when(~F.coalesce(legal, F.lit(False)), "PRODUCTION_STATE_TRANSITION_REJECTED").when((to == "stored") & ~F.coalesce(manifest_ok, F.lit(False)), "AUTHORITATIVE_MANIFEST_REQUIRED").when((to == "stored") & (F.coalesce(percent, F.lit(100)) != 100), "COMPLETED_PERCENT_MISMATCH")


def checkpoint_hits(wanted: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("stage", "input_fingerprint")) -> tuple[DataFrame, DataFrame]:
    """(wanted rows with their stored payload, wanted rows to be computed): corrupt artifacts are misses."""
    good = stored.where(F.col("payload_hash") == F.sha2("payload", 256)).select(*keys, "payload")
    return wanted.join(good, list(keys)), wanted.join(good, list(keys), "left_anti")
