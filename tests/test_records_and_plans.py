from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kunits.operators import ops, records
from kunits.plans import commit, writer
from kunits.schema import RELATIONS, TRANSITIONS

RECORD = "record_kind string, record_id string, title string, library string, created_at string, updated_at string, state string, archive_outcome string, source_path string, category string, item_type string, project_ids array<string>, odd string"


def make(spark, *rows: dict):
    base = dict.fromkeys(("record_kind", "record_id", "title", "library", "created_at", "updated_at", "state", "archive_outcome", "source_path", "category", "item_type", "project_ids", "odd"))
    return spark.createDataFrame([tuple({**base, "record_id": "r", "title": "t", "library": "business", "created_at": "c", "updated_at": "u", **r}.values()) for r in rows], RECORD)


def test_records(spark):
    df = make(
        spark, {"record_kind": "project", "state": "won", "library": "active_tender", "project_ids": ["b", " a", "b", ""], "odd": "kept"}, {"record_kind": "project", "state": "archived"}, {"record_kind": "source_document"},
        {"record_kind": "business_item", "category": "nope", "item_type": "nope"}, {"record_kind": "company_knowledge", "library": "active_tender"}, {"record_kind": "x", "record_id": " "},
    )
    good, bad = records.migrate(df)
    g = good.collect()
    assert len(g) == 1
    assert g[0].project_ids == ["a", "b"]
    assert "kept" in g[0].extensions
    found = {r.record_kind: r.errors for r in bad.collect()}
    assert found["project"] == ["归档项目必须说明 archive_outcome"]
    assert len(found["business_item"]) == 2
    assert "record_id 不能为空" in found["x"]
    again, none = records.migrate(good)
    assert none.count() == 0
    assert [r.project_ids for r in again.collect()] == [["a", "b"]]


def test_transitions(spark):
    rows = [(a, b) for a in TRANSITIONS for b in TRANSITIONS] + [("x", "won"), (None, "won")]
    df = spark.createDataFrame(rows, "from_state string, to_state string")
    for r in records.with_transition(df).collect():
        assert r.allowed == (r.to_state in TRANSITIONS.get(r.from_state, ()))
    cases = [("won", "archived", "won_completed", None, None), ("won", "archived", "lost", None, "归档结果与当前项目状态不匹配"), ("paused", "archived", "paused_by_decision", None, "暂停项目只能在明确作出归档决定后归档"), ("paused", "archived", "paused_by_decision", True, None), ("lead", "won", None, None, "不允许的状态转换"), ("q", "won", None, None, "项目状态无效")]
    got = spark.createDataFrame([c[:4] for c in cases], "a string, b string, o string, e boolean").select(records.transition_reason(F.col("a"), F.col("b"), F.col("o"), F.col("e")).alias("r")).collect()
    assert [g.r for g in got] == [c[4] for c in cases]


def test_legacy_and_json(spark):
    cards = spark.createDataFrame([("c 1", "T", 1)], "card_id string, title string, nth int")
    tasks = spark.createDataFrame([(None, "in/a.pdf", 1)], "task_id string, source_path string, nth int")
    projects = spark.createDataFrame([("p", "T", "lost", "lost", None, 1), ("q", "T", "won", None, None, 2)], "record_id string, title string, state string, archive_outcome string, explicit_archival_decision boolean, nth int")
    got = {r.source_ref: r.ready for r in records.legacy_plan(cards, tasks, projects).collect()}
    assert got == {"legacy-card:c-1": True, "legacy-task:in-a.pdf": True, "legacy-project:p": True, "legacy-project:q": False}
    a = spark.createDataFrame([('{"schema_version":"1.3","x":"1"}',), ('{"schema_version":"2.0"}',)], "artifact string")
    once = records.migrate_review(a)
    assert [r.artifact for r in once.collect()] == [r.artifact for r in records.migrate_review(once).collect()]
    assert '"x":"1"' in once.head().artifact
    errors = spark.createDataFrame([('{"a":"x","n":3}',), ('{"n":"3"}',), ("no",)], "v string").select(records.schema_errors(F.col("v"), {"a": "string", "n": "number"}).alias("e")).collect()
    assert [r.e for r in errors] == [[], ["a:missing", "n:type"], ["not_json"]]


def plan_records(spark, n: int = 3):
    rows = [("business_item", f"bi-{i}", f"Title {i}", "business", "c", "u", f"summary {i}", ["s1"], "s1") for i in range(n)]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, title string, library string, created_at string, updated_at string, summary string, source_document_ids array<string>, owner_source_id string")
    df = df.withColumn("category", F.lit("risks_issues")).withColumn("path", writer.route_path(F.col("record_kind"), F.col("record_id"), F.col("library"), F.col("category"), F.lit(None).cast("string")))
    return writer.serialize(df)


INDEX = "key string, record_id string, path string, content_hash string"


def test_plan_is_idempotent(spark):
    records_ = plan_records(spark)
    none, files = spark.createDataFrame([], INDEX), spark.createDataFrame([], "path string, content string")
    p = writer.plan(records_, none, files)
    assert p["counts"] == {"create": 3}
    assert not p["blocked"]
    index = records_.select(F.col("record_id").alias("key"), "record_id", "path", "content_hash")
    there = records_.select("path", "content")
    assert writer.plan(records_, index, there)["counts"] == {"noop": 3}
    changed = there.withColumn("content", F.when(F.col("path").contains("bi-1"), F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    p = writer.plan(records_, index, changed)
    assert p["blocked"]
    assert [c.cause for c in p["conflicts"].collect()] == ["optimistic_hash_mismatch"]
    foreign = there.withColumn("content", F.regexp_replace("content", "bi-2", "bi-9"))
    assert "path_occupied_by_different_id" in [c.cause for c in writer.plan(records_, index, foreign)["conflicts"].collect()]
    two = there.unionByName(there.where("path like '%bi-0%'").withColumn("path", F.lit("elsewhere.md")))
    assert "same_id_multiple_paths" in [c.cause for c in writer.plan(records_, index, two)["conflicts"].collect()]
    with pytest.raises(ValueError, match="上限"):
        writer.plan(records_, none, files, limits={**writer.settings(), "max_records": 2})


def test_archive_and_roots(spark):
    actions = spark.createDataFrame([("noop", writer.ACTIVE_ROOT + "/P/c/f.md", "h"), ("create", writer.ACTIVE_ROOT + "/P/c/g.md", None), ("update", "other/x.md", "h")], "action string, path string, prior_hash string")
    got = {r.action: (r.path, r.from_path) for r in writer.archive(actions).collect()}
    assert got["move"] == (writer.BUSINESS_ROOT + "/complete_historical_projects/P/c/f.md", writer.ACTIVE_ROOT + "/P/c/f.md")
    assert got["update"] == ("other/x.md", None)
    writer.check_roots("a/b", "a/c", ["x"])
    for bad in (("a", "a", []), ("a", "a/b", []), ("a", "b", ["b/state"])):
        with pytest.raises(ValueError):
            writer.check_roots(*bad)
    with pytest.raises(Exception, match="分类未确定"):
        spark.range(1).select(writer.route_path(F.lit("project"), F.lit("r"), F.lit("business"), F.lit(None).cast("string"), F.lit("p"))).collect()
    assert writer.settings({"enabled": True, "mode": "structured-write", "max_records": 9999})["max_records"] == 250


def test_relations(spark):
    asked = spark.createDataFrame([("bi", "business_item", "d", 0, "derived_from", ["s"]), ("bi", "business_item", "d", 1, "derived_from", ["p"]), ("bi", "business_item", "d", 2, "nope", ["s"]), ("bi", "business_item", "d", 3, "related", ["s", "p"]), ("bi", "business_item", "d", 4, "belongs_to", []), ("bi", "business_item", "d", 5, "derived_from", ["s"])], "from_id string, from_kind string, source_document_id string, nth int, type string, target_ids array<string>")
    targets = spark.createDataFrame([("s", "source_document", "S", "s.md"), ("p", "project", "P", "p.md")], "record_id string, record_kind string, title string, path string")
    good, bad = writer.resolve_relations(asked, targets)
    assert [(r.type, r.target_id) for r in good.collect()] == [("derived_from", "s")]
    assert {r.nth: r.reason for r in bad.collect()} == {1: "type_mismatch_or_missing", 2: "unsupported_relation_type", 3: "ambiguous_target", 4: "unresolved_target"}
    assert [len(g.issues) for g in writer.unresolved_groups(bad).collect()] == [1, 1, 1, 1]
    assert set(RELATIONS) == {r.type for r in writer.relation_rules(spark).collect()}
    assert writer.two_way(spark.createDataFrame([("a", "b", "related"), ("b", "a", "related")], "from_id string, to_id string, type string")).count() == 2


def test_identities(spark):
    df = spark.createDataFrame([("x", None, None, "h"), (None, "i", None, None), (None, None, "m", "h"), (None, None, None, "h")], "a string, b string, c string, d string")
    got = [r.i for r in df.select(writer.source_identity(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("i")).collect()]
    assert got == ["explicit:x", "ingestion:i", "provider:m", "initial-hash:h"]
    with pytest.raises(Exception, match="稳定身份"):
        spark.range(1).select(writer.source_identity(*[F.lit(None).cast("string")] * 4)).collect()
    index = spark.createDataFrame([("a", "a", "x/a.md", "h"), ("b", "b", "x/a.md", "h"), ("c", "d", "y.md", "h"), ("e", "e", "../z", "h")], INDEX)
    kept, clashes, gone = writer.valid_index(index)
    assert (kept.count(), clashes.count(), gone.count()) == (2, 1, 2)


def test_commit_verify_rollback(spark, tmp_path):
    store = commit.VersionedStore(spark, str(tmp_path / "store"))
    first = writer.plan(plan_records(spark), spark.createDataFrame([], INDEX), spark.createDataFrame([], "path string, content string"))
    done = store.commit(first["actions"], "run", "task")
    assert store.version() == 1
    assert commit.commit_counts(done).head().knowledge_created == 3
    mark = store.fingerprint()
    more = plan_records(spark, 4).where("record_id in ('bi-3', 'bi-0')").withColumn("action", F.lit("create"))
    store.commit(more, "run2", "task", expected=1)
    assert store.read().count() == 4
    with pytest.raises(commit.CommitError, match="expected version"):
        store.commit(more, "run", "task", expected=1)
    broken = more.withColumn("content", F.lit("nothing"))
    with pytest.raises(commit.CommitError) as e:
        store.commit(broken, "run3", "task")
    assert e.value.code == "STRUCTURED_WRITE_NOT_PERSISTED"
    assert (store.version(), store.read().count()) == (2, 4)  # the failed version never showed
    for kwargs in ({"run_id": "", "task_id": "t"}, {"run_id": "r", "task_id": ""}, {"run_id": "r", "task_id": "t", "blocked": True}):
        with pytest.raises(commit.CommitError):
            store.commit(more, **kwargs)
    with pytest.raises(commit.CommitError):
        store.rollback(1, expected_hash="other")
    store.rollback(1, expected_hash=store.fingerprint())
    assert store.fingerprint() == mark
    assert {r.status for r in store.manifest().collect()} == {"committed", "failed"}
    with pytest.raises(commit.CommitError) as e:  # another commit has made this pointer
        store._point(2, 3)
    assert (e.value.code, store.version()) == ("OPTIMISTIC_VERSION_MISMATCH", 1)
    for move, cut in ((4, ""), (5, '{"vers')):  # crashes while a pointer is written
        (tmp_path / "store" / "pointers" / str(move)).write_text(cut)
        assert store.version() == 1
    store.rollback(2)
    assert store.version() == 2


def _sizes(root) -> dict[str, int]:
    return {folder.name: sum(f.stat().st_size for f in folder.rglob("*.parquet")) for folder in (root / "data").iterdir()}


def test_a_commit_writes_the_buckets_that_change(spark, tmp_path):
    store = commit.VersionedStore(spark, str(tmp_path / "store"), buckets=16)
    made = lambda ids, body: spark.createDataFrame([("create", f"{i}.txt", f"r{i}", "project", "src", body * 400, "") for i in ids], f"action string, {commit.STORED}")
    whole = made(range(400), "a").withColumn("content", F.concat("content", F.sha2("record_id", 512)))
    plain = commit.verify
    try:
        commit.verify = lambda actions, files: actions.withColumn("reason", F.lit(None).cast("string"))
        store.commit(whole, "r", "t")
        first = _sizes(tmp_path / "store")
        store.commit(made([7], "b"), "r", "t")
    finally:
        commit.verify = plain
    after = _sizes(tmp_path / "store")
    new = {name: n for name, n in after.items() if name not in first}
    assert sum(new.values()) < sum(first.values()) / 4  # a bucket of sixteen
    assert (store.read().count(), store.read(1).count()) == (400, 400)
    assert store.read().where("record_id = 'r7'").head().content.startswith("bbb")
    assert store.read(1).where("record_id = 'r7'").head().content.startswith("aaa")
    assert sum(folder == next(iter(new)) for folder in store.folders(2).values()) == 1
    assert store.unreferenced(1) == []
    store.rollback(1)
    assert store.unreferenced(1) == list(new)


def test_of_two_writers_one_wins_and_nothing_is_lost(spark, tmp_path):
    now = [1000.0]
    store, other = (commit.VersionedStore(spark, str(tmp_path / "store"), lease_seconds=60, clock=lambda: now[0]) for _ in range(2))
    one = plan_records(spark, 4).withColumn("action", F.lit("create"))
    two = one.where("record_id = 'bi-0'")
    mine = store.acquire("one")
    with pytest.raises(commit.CommitError) as e:
        other.commit(two, "r2", "t2")  # while the lease holds
    assert (e.value.code, other.version()) == ("STORE_LOCKED", 0)
    now[0] += 61  # the first writer hangs, its lease runs out, the other writes
    other.commit(two, "r2", "t2")
    assert (other.version(), other.read().count()) == (1, 1)
    with pytest.raises(commit.CommitError) as e:
        store.commit(one, "r1", "t1", lease=mine)  # wakes up with a lease of the past
    assert e.value.code == "LEASE_LOST"
    assert (store.version(), store.read().count()) == (1, 1)
    store.commit(one, "r1", "t1")
    assert (store.version(), store.read().count()) == (3, one.count())
    # Both pass the fence at once: the pointer decides.
    lease = store.acquire("one")
    fence = other._fence
    store._fence = other._fence = lambda _: None
    late = commit.VersionedStore._create

    def meanwhile(self, name, value, taken):
        if self is store and name.startswith("pointers/"):
            late(other, name, {"version": 1}, taken)
        late(self, name, value, taken)

    commit.VersionedStore._create = meanwhile
    try:
        with pytest.raises(commit.CommitError) as e:
            store.commit(one, "r1", "t1", lease=lease)
    finally:
        commit.VersionedStore._create = late
    assert (e.value.code, store.version(), store.read().count()) == ("OPTIMISTIC_VERSION_MISMATCH", 1, 1)
    with pytest.raises(commit.CommitError):
        fence(commit.Lease(1, "one", 0.0))


def test_leases_that_end(spark, tmp_path):
    store = commit.VersionedStore(spark, str(tmp_path / "store"))
    first = store.acquire("a")
    assert store.acquire("a").number == first.number + 1  # one's own is extended
    store.release(store.lease())
    assert store.acquire("b").holder == "b"
    (tmp_path / "store" / "leases" / "9").write_text('{"hold')  # a crash while a lease is written
    assert store.acquire("c").number == 10



def test_verified_facts_and_audit(spark):
    h = "a" * 64
    rows = [("t", "visible_verified", "r1", "business_item", "/x/a.md", "run", "run", "markdown", "business", h, "txn", 1), ("t", "visible_verified", "r1", "business_item", "x/a.md", "run", "run", "markdown", "business", h, "txn", 2), ("t", "visible_verified", "r2", "business_item", "x/b.md", "old", "run", "markdown", "business", h, "txn", 3), ("t", "visible_verified", "r3", "source_document", "x/c.md", "run", "run", "markdown", "business", h, "txn", 4), ("t", "visible_verified", "r4", "business_item", "x/d.md", "run", "run", "markdown", "business", "zz", "txn", 5)]
    df = spark.createDataFrame(rows, "task_id string, state string, record_id string, record_kind string, final_path string, run_id string, task_run_id string, vault_file_type string, target_library string, content_hash string, transaction_id string, nth int")
    facts = commit.verified_facts(df)
    assert [(r.verified, r.paths) for r in facts.collect()] == [(1, ["x/a.md"])]
    tasks = spark.createDataFrame([("t", "stored", None, 1, 1, 1, ["x/a.md"]), ("u", "success", None, 2, 0, 0, [])], "task_id string, status string, terminal_outcome string, count_verified int, count_written int, count_knowledge int, output_paths array<string>")
    got = {r.task_id: r.errors for r in commit.audit(tasks, facts).collect()}
    assert got == {"t": [], "u": ["success_without_visible_verified_record", "verified_count_drift"]}
    assert {r.task_id: r.status for r in commit.apply_facts(tasks, facts).collect()} == {"t": "stored", "u": "verification_required"}


def test_production_states(spark):
    cases = [("waiting", "processing", None, None, None), ("waiting", "stored", True, 100, "PRODUCTION_STATE_TRANSITION_REJECTED"), ("processing", "stored", False, 100, "AUTHORITATIVE_MANIFEST_REQUIRED"), ("processing", "stored", True, 99, "COMPLETED_PERCENT_MISMATCH"), ("processing", "stored", True, None, None), ("x", "y", None, None, "UNKNOWN_STATE")]
    got = spark.createDataFrame([c[:4] for c in cases], "a string, b string, m boolean, p int").select(commit.production_transition(F.col("a"), F.col("b"), F.col("m"), F.col("p")).alias("r")).collect()
    assert [g.r for g in got] == [c[4] for c in cases]
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "y int")
    assert sorted((r.side, r.value) for r in commit.set_difference(a, b).collect()) == [("left", 1), ("right", 3)]


def test_operations(spark):
    rows = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(60)], "id long, s string")
    a = ops.stratified_sample(rows, F.col("id"), ["s"], 10, "seed").collect()
    b = ops.stratified_sample(rows.repartition(5).orderBy(F.desc("id")), F.col("id"), ["s"], 10, "seed").collect()
    assert a == b
    assert sum(r.s == "y" for r in a) == 5
    codes = spark.createDataFrame([(429, None), (401, None), (None, "socket hang up"), (418, "x"), (None, "?"), (502, None)], "s int, m string").select(ops.classify_failure(F.col("s"), F.col("m")).alias("c")).collect()
    assert [(r.c.code, r.c.retryable) for r in codes] == [("RATE_LIMITED", True), ("AUTH_FAILED", False), ("NETWORK", True), ("BAD_REQUEST", False), ("UNKNOWN", False), ("PROVIDER_UNAVAILABLE", True)]
    events = spark.createDataFrame([("r", i, "a" if i < 27 else "b") for i in range(30)], "run string, at int, scope string")
    assert [(r.scope, r.first, r.last, r.hits) for r in ops.event_ranges(events, ["run"], ["at"], "scope").orderBy("range_no").collect()] == [("a", 0, 26, 27), ("b", 27, 29, 3)]
    assert ops.bounded_report(events, ["run"], ["at"], 200).count() < 10
    assert ops.bounded_report(events, ["run"], ["at"], 10**6).count() == 30


def test_providers(spark):
    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(10)], "id string, text string").coalesce(1)
    none = ops.provider_map(rows, "id", None, "out string")
    assert {r.error for r in none.collect()} == {"PROVIDER_NOT_CONFIGURED"}

    def upper(batch):
        if any(r["id"] == "9" for r in batch):
            raise RuntimeError("boom")
        return [{"id": r["id"], "out": r["text"].upper()} for r in reversed(batch)]

    done = ops.provider_map(rows, "id", upper, "out string", size=4)
    good = {r.id: r.out for r in done.where("error is null").collect()}
    assert good["3"] == "TEXT 3"
    assert sorted(r.id for r in ops.pending(rows, done, "id").collect()) == ["8", "9"]
    full = ops.complete(rows.withColumn("doc", F.lit("d")), done, "doc", "id").head()
    assert not full.complete
    missing = ops.provider_map(rows, "id", lambda b: [{"id": b[0]["id"], "out": "x"}], "out string", size=5)
    assert {r.error for r in missing.collect()} == {"PROVIDER_IDS_INVALID"}
    ids = ops.id_sets_match(rows.select("id"), rows.where("id <> '1'").select("id").unionByName(spark.createDataFrame([("2",), ("x",)], "id string")), "id")
    assert {(r.id, r.problem) for r in ids.collect()} == {("1", "missing"), ("2", "duplicate"), ("x", "extra")}


def test_summary_tree_and_regeneration(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i}", f"t{i}") for i in range(11)] + [("e", 0, "x", "only")], "doc string, chunk_no int, chunk_id string, text string")
    got = {r.doc: (r.summary, r.ids) for r in ops.hierarchical_summary(chunks, "doc", lambda texts: "+".join(texts), fan=3).collect()}
    assert got["d"][0] == "+".join(f"t{i}" for i in range(11))
    assert sorted(got["d"][1]) == sorted(f"c{i}" for i in range(11))
    assert got["e"] == ("only", ["x"])
    atoms = spark.createDataFrame([("c1", ["p1"]), ("c2", ["p2"]), ("c3", ["p2"])], "card_id string, point_ids array<string>")
    points, refused = ops.regeneration_plan(spark.createDataFrame([("c1",), ("c2",), ("c9",)], "card_id string"), atoms)
    assert [r.point_id for r in points.collect()] == ["p1"]
    assert sorted(r.card_id for r in refused.collect()) == ["c2", "c9"]


def test_small_operations(spark):
    items = spark.createDataFrame([("a", "pending", True, "matched", []), ("b", "pending", True, "conflict", []), ("c", "done", True, "matched", []), ("d", "pending", True, "matched", ["gate"]), ("e", "pending", None, "matched", [])], "id string, status string, has_evidence boolean, consistency string, hard_gates array<string>")
    good, rest = ops.approval_plan(items)
    assert ([r.id for r in good.collect()], rest.count()) == (["a"], 4)
    c = spark.createDataFrame([(1.0, 0.9, False), (1.0, 0.9, True), (0.2, 0.2, False)], "parse double, evidence double, hard boolean").select(ops.confidence({"parse": 1, "evidence": 1}, [F.col("hard")]).alias("c")).collect()
    assert [r.c.decision for r in c] == ["auto_ingest", "review", "review"]
    paths = ["", "a/", "/a.md", "../a.md", "a.exe", "a/b.md"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(ops.component_path_problem(F.col("p")).alias("r")).collect()
    assert [r.r for r in got] == ["empty", "trailing_slash", "absolute", "traversal", "extension", None]
    user, built = spark.createDataFrame([("x", "{bad")], "name string, content string"), spark.createDataFrame([("x", "{}"), ("y", "{}")], "name string, content string")
    assert {r.name: (r.origin, r.valid) for r in ops.contracts(user, built).collect()} == {"x": ("user", False), "y": ("builtin", True)}
    page = ops.page(spark.range(120), ["id"], 2)
    assert [r.id for r in page.collect()] == list(range(100, 120))
    routes = ops.fuzzy_route(spark.createDataFrame([("技术方案（二）",), ("合同",), ("无关",)], "name string"), spark.createDataFrame([("技术方案", "a"), ("合同", "b")], "key string, route string"))
    assert {r.name: r.route for r in routes.collect()} == {"技术方案（二）": "a", "合同": "b", "无关": None}
    regions = spark.createDataFrame([("r1", "fact", "中文内容", ("zh",)), ("r2", "fact", "shall not", ("en",)), ("r3", "fact", "Deliver 12 kg", ("en",)), ("r4", "noise", "x", ("en",))], "region_id string, semantic_kind string, text string, source_language struct<language:string>")
    done, asked = ops.translation_requests(regions, spark.createDataFrame([], "cache_key string, translated_text string"))
    assert {r.region_id: r.provenance for r in done.collect()} == {"r1": "source-zh", "r2": "deterministic"}
    assert [(r.region_id, r.preserve_exactly) for r in asked.collect()] == [("r3", ["12 kg"])]
