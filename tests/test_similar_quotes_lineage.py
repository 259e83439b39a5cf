"""Similar signatures, quotes and evolution against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kunits.operators import lineage, quotes, similar, vectors
from kunits.session import Scratch

# Signatures


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _distance(a: int, b: int) -> int:
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def _marks(n: int = 300, seed: int = 0) -> list[int]:
    """Signatures in families: each near one of few centres, some equal, some with the sign bit changed."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(12)]
    out = [0, (1 << 64) - 1, 1, 1 << 63]
    for _ in range(n):
        m = r.choice(centres)
        for _ in range(r.randrange(6)):
            m ^= 1 << r.choice([r.randrange(64), 63, 0])
        out.append(m)
    return [_signed(m) for m in out]


@pytest.mark.parametrize(("radius", "spare"), [(0, 1), (1, 2), (3, 3), (5, 1), (6, 2)])
def test_near_pairs_are_all_pairs(spark, radius, spare):
    marks = _marks()
    found = similar.near_pairs(spark.createDataFrame([(m,) for m in marks] + [(None,)], "mark long"), radius, spare=spare).collect()
    each = sorted(set(marks))
    want = {(a, b, _distance(a, b)) for i, a in enumerate(each) for b in each[i + 1 :] if _distance(a, b) <= radius}
    assert sorted(map(tuple, found)) == sorted(want)  # each pair once


def test_masks_cover_every_choice():
    masks = similar.key_masks(3)
    assert len(masks) == len(set(masks)) == 20
    r = random.Random(1)
    for _ in range(200):
        flipped = sum(1 << b for b in r.sample(range(64), 3))
        assert any(m & flipped == 0 for m in masks)
    with pytest.raises(ValueError, match="radius"):
        similar.key_masks(64, 1)


def test_classes_stand_for_their_rows(spark):
    rows = [(i, m) for i, m in enumerate([7] * 40 + [6] * 3 + [4, 1 << 40, None, None])]
    df = spark.createDataFrame(rows, "id long, mark long").withColumn("n", F.lit("own"))
    assert [tuple(r) for r in similar.class_pairs(df, "id", 1).collect() if r.left_id == 0] == [(0, 40, 40, 3, 1)]
    got = {r.id: tuple(r)[1:] for r in similar.neighbours(df, "id", 1).collect()}
    assert got[5] == (0, 40, 1, 1) and got[41] == (40, 3, 2, 1) and got[43] == (43, 1, 1, 1) and got[44] == (44, 1, 0, None)
    assert got[45] == (45, 1, 0, None) and got[46] == (46, 1, 0, None)
    assert similar.neighbours(df.where("false"), "id", 3).count() == 0


def brute_leaders(rows: list[tuple], most: int) -> dict:
    leaders: dict = {}
    out = {}
    for group, i, mark in sorted(rows, key=lambda x: x[1]):
        first = next((j for j, m in leaders.setdefault(group, []) if _distance(m, mark) < most), None)
        if first is None:
            leaders[group].append((i, mark))
        out[i] = i if first is None else first
    return out


@pytest.mark.parametrize(("most", "first", "limit"), [(32, 16, 256), (20, 2, 4), (6, 1, 2), (1, 3, 3)])
def test_leaders_are_those_of_the_order(spark, monkeypatch, most, first, limit):
    monkeypatch.setattr(similar, "FIRST_LEADERS", first)
    monkeypatch.setattr(similar, "MOST_LEADERS", limit)
    r = random.Random(most)
    rows = [(r.choice(["a", "b", None]), i, m) for i, m in enumerate(_marks(26 if most == 1 else 80, most))]
    df = spark.createDataFrame(rows, "group string, id long, mark long").repartition(5).withColumn("nth", F.lit("own"))
    found = similar.leader_groups(df, ["group"], "id", most).collect()
    assert {x.id: x.leader for x in found} == brute_leaders(rows, most)
    assert len(found) == len(rows) and found[0].nth == "own"


def test_leaders_of_odd_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, 5), (None, 4, 5)], "group string, id long, mark long")
    assert {x.id: x.leader for x in similar.leader_groups(df, ["group"], "id", 3).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    assert similar.leader_groups(df.where("false"), ["group"], "id", 3).count() == 0
    with pytest.raises(ValueError, match="leader"):
        similar.leader_groups(df, ["group"], "id", 0)


def test_paraphrases_meet_whatever_stands_before_them(spark):
    said = "the pump room of building four needs new filters and cleaner ducts before the winter season starts"
    rows = [("d", "a1", "zebra quilt violin harbour meadow lantern orbit"), ("d", "a2", said), ("d", "a3", said.replace("new filters", "fresh filters")), ("d", "a4", said + " 12 kW"), ("e", "a2", said), ("d", "a9", "!!!")]
    found = {(r.source_document_id, r.atom_id): r.group_id for r in vectors.consolidate_atoms(spark.createDataFrame(rows, "source_document_id string, atom_id string, text string"), most=24).collect()}
    assert found == {("d", "a1"): "a1", ("d", "a2"): "a2", ("d", "a3"): "a2", ("d", "a4"): "a4", ("e", "a2"): "a2"}


# Quotes


def test_thousand_quotes_of_a_document(spark, monkeypatch):
    monkeypatch.setattr(quotes, "CHUNK", 40_000)  # several chunks and parts
    monkeypatch.setattr(quotes, "PART", 20_000)
    r = random.Random(5)
    words = ["ab", "ａｂ", "b a", "ba b", "abba", "①", "x", "é", "é", "ﬁn"]
    blocks = [("d1" if i % 3 else "d2", f"b{i}", " ".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(150)] + [("d1", "bn", None), ("d1", "be", "")]
    asked = [("d1" if i % 4 else "d2", f"q{i}", " ".join(r.choice(words) for _ in range(1 + r.randrange(5)))) for i in range(1300)] + [("d1", "qe", ""), ("d1", "qs", " \n"), ("d1", "qn", None), ("d9", "q?", "x")]
    got = quotes.quote_hits(spark.createDataFrame(asked, "doc string, quote_id string, quote string"), spark.createDataFrame(blocks, "doc string, block_id string, text string"), "doc").collect()
    want = [(q, b, said in text) for d, q, said in asked if quotes.compact(said) for e, b, text in blocks if d == e and text and quotes.compact(said) in quotes.compact(text)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({q for q, *_ in want}) > 1000


def test_reconciled_quotes_with_hints(spark):
    blocks = [("d", "b1", "the same line", True), ("d", "b2", "the same line", True), ("d", "b3", "thesame line", True), ("d", "b4", "hidden words", False), ("d", "b5", "words without flag", None), ("e", "b1", "other text", True)]
    asked = [("d", "q1", "same line", "b2"), ("d", "q2", "same line", "b9"), ("d", "q3", "t h e s a m e", None), ("d", "q4", "hidden words", None), ("d", "q5", "without flag", None), ("d", "q6", "other text", None), ("e", "q7", "other text", None), ("d", "q8", "thesame", "b1"), ("d", "q9", "", None)]
    found = {r.quote_id: tuple(r)[1:] for r in quotes.reconcile(spark.createDataFrame(asked, "d string, quote_id string, quote string, hint string"), spark.createDataFrame(blocks, "d string, block_id string, text string, card_eligible boolean"), "d").collect()}
    assert found == {
        "q1": ("resolved", "b2", True, 3), "q2": ("ambiguous_quote", None, True, 3), "q3": ("ambiguous_quote", None, False, 3), "q4": ("quote_not_found", None, False, 0), "q5": ("resolved", "b5", True, 1),
        "q6": ("quote_not_found", None, False, 0), "q7": ("resolved", "b1", True, 1), "q8": ("resolved", "b3", True, 1), "q9": ("quote_not_found", None, False, 0),
    }


@pytest.mark.parametrize("most", [quotes.CHUNK, 300])
def test_texts_with_quotes(spark, most):
    texts = [(1, "abcabc"), (2, "bca"), (3, ""), (4, None), (5, "xyz abc"), (5, "abc again")]
    asked = [("a", "abc"), ("b", "bc"), ("c", ""), ("d", None), ("e", "zz"), ("f", "abc"), (None, "xyz")]
    found = quotes.texts_with_quotes(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "quote_id string, quote string"), "id", most=most).collect()
    want = [(q, i) for q, said in asked for i, text in texts if said is not None and text is not None and said in text]
    assert Counter(map(tuple, found)) == Counter(want)


# Evolution


def brute_evolution(ids: list[int], edges: list[tuple]) -> dict:
    known, follows, sources = set(ids), {}, {}
    for s, t, kind, o in edges:
        if kind == "supersedes" and s in known and t in known:
            sources.setdefault(t, {}).setdefault(s, []).append(o)
    for t, found in sources.items():
        follows[t] = max(((max(o), s) for s, o in found.items()))[1]
    out = {}
    for i in known:
        at, seen = i, [i]
        while at in follows and follows[at] not in seen:
            at = follows[at]
            seen.append(at)
        ring = at in follows
        if not ring:
            out[i] = (at, len(seen) - 1, "none", len(sources.get(i, ())))
        else:
            out[i] = (None, None, "on" if follows[at] == i else "into", len(sources.get(i, ())))
    for i, x in list(out.items()):  # a record before a ring meets the ring's entry again, not itself
        if x[2] != "none":
            at, n = i, 0
            while n <= len(known):
                at, n = follows[at], n + 1
                if at == i:
                    break
            out[i] = (None, None, "on" if at == i and n <= len(known) else "into", x[3])
    return out


EDGES = "source long, target long, type string, order long"


@pytest.mark.parametrize("seed", range(4))
def test_evolution_against_brute_force(spark, seed):
    r = random.Random(seed)
    ids = list(range(60))
    edges = [(r.randrange(66), r.randrange(66) if seed % 2 else 0, "supersedes" if r.random() < 0.9 else "related", r.randrange(9)) for _ in range(70)]
    edges = [(s, t if seed % 2 else max(0, s - 1 - r.randrange(3)), k, o) for s, t, k, o in edges] + [(None, 3, "supersedes", 1), (3, None, "supersedes", 1)]
    edges += edges[:10]
    records = spark.createDataFrame([(i, "own") for i in [*ids, *ids[:5]]] + [(None, "own")], "id long, at string")
    scratch = Scratch(spark)
    found = {x.id: tuple(x)[1:] for x in lineage.evolution_index(records, spark.createDataFrame(edges, EDGES), scratch=scratch).collect()}
    assert found == brute_evolution(ids, [e for e in edges if None not in e])
    assert len([1 for _, path in scratch.written if "pointers" in path]) == 1  # a round's table goes with the next one


def test_evolution_of_a_long_chain_and_rings(spark):
    chain = [(i + 1, i, "supersedes", 0) for i in range(300)]
    ring = [(1001, 1000, "supersedes", 0), (1002, 1001, "supersedes", 0), (1000, 1002, "supersedes", 0), (2000, 2000, "supersedes", 0)]
    tail = [(1000 if i == 900 else i - 1, i, "supersedes", 0) for i in range(900, 940)]
    ids = [*range(301), 1000, 1001, 1002, 2000, *range(900, 940)]
    found = {x.id: tuple(x)[1:] for x in lineage.evolution_index(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(chain + ring + tail, EDGES)).collect()}
    assert found[0] == (300, 300, "none", 1) and found[300] == (300, 0, "none", 0)
    assert {i for i, x in found.items() if x[2] == "on"} == {1000, 1001, 1002, 2000}
    assert {i for i, x in found.items() if x[2] == "into"} == set(range(900, 940))


def test_evolution_without_edges(spark):
    records, none = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([], EDGES)
    assert sorted(map(tuple, lineage.evolution_index(records, none).collect())) == [(1, 1, 0, "none", 0), (2, 2, 0, "none", 0)]
    assert lineage.evolution_index(records.where("false"), none).count() == 0


# Plans and costs


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_signatures_are_not_broadcast(spark):
    """a table's keys are twenty times its rows, which its size doesn't show."""
    rows = spark.createDataFrame([(i, i) for i in range(50)], "doc_id long, mark long")
    assert "Broadcast" not in _plan(similar.near_pairs(rows, 3))
    assert "Broadcast" not in _plan(similar.class_pairs(rows, "doc_id", 3))
    assert "Broadcast" not in _plan(similar.neighbours(rows, "doc_id", 3))


def test_bits_are_counted_over_long_and_empty_texts(spark, monkeypatch):
    """Texts longer than what is counted at a time, and none; against a count bit by bit."""
    import hashlib

    import pyarrow as pa

    r = random.Random(5)
    texts = ["", "one", " ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(500)), "a b", "", "zwei drei \u00fcber zwei"]
    lists = [[int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in t.split()] for t in texts]
    wanted = [_signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))) for hs in lists]
    monkeypatch.setattr(vectors, "BITS_AT_ONCE", 7)
    assert vectors.majorities(pa.array([[_signed(h) for h in hs] for hs in lists], pa.list_(pa.int64()))).tolist() == wanted
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    plain = rows.select("i", vectors.simhash(F.col("t"), vectors.md5_long).alias("m"), vectors.simhash(F.col("t"), lambda w: vectors.md5_long(w)).alias("n")).orderBy("i").collect()
    assert [x.m for x in plain] == [x.n for x in plain] == wanted
