"""Language profiles, ranked search and the filter audit against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from fixtures import DOCS, clashing, doc, odd_documents, prose

from kunits.llm import filter_audit, impact_search, rank_profiles

ODD_TEXTS = ["", "   ", "123 !!", "a", "A b", "it's  two—words", "ÉTÉ été straße", "日本語 の テキスト 🙂", "x" * 50, "word " * 40, "½ a²b ①", "end.", " lead", "𐐀𐐁 deseret", "naïvé İstanbul"]


# Language


def brute_grams(text: str) -> Counter:
    found: Counter = Counter()
    for word in re.findall(r"\w+", "".join(c if c.isalpha() else " " for c in text.lower())):
        marked = f"_{word}_"
        for n in (1, 2, 3):
            found.update(g for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) != "_")
    return found


def brute_top(found: Counter, size: int) -> list[str]:
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0].replace("_", "\x00")))[:size]]


def brute_judge(text: str | None, lists: dict[str, list[str]], size: int) -> tuple[str, float]:
    listed = brute_top(brute_grams(text or ""), size)
    if not listed or not lists:
        return "und", 0.0
    far = sorted((sum(abs(i - of.index(g)) if g in of else size for i, g in enumerate(listed)), lang) for lang, of in lists.items())
    second = far[1][0] if len(far) > 1 else size * len(listed)
    return far[0][1], (second - far[0][0]) / second if second else 0.0


@pytest.mark.parametrize("chunk", [1 << 20, 3, 1])
def test_grams(monkeypatch, chunk):
    monkeypatch.setattr(rank_profiles, "CHUNK", chunk)
    for text in [*ODD_TEXTS, prose(1, 200), "".join(chr(0x4E00 + i) for i in range(400))]:
        keys, n = rank_profiles.grams(text)
        assert (np.diff(keys) > 0).all()
        assert {rank_profiles.shown(int(k)): int(c) for k, c in zip(keys, n, strict=True)} == brute_grams(text)


def language_rows() -> list[tuple]:
    said = {"xx": "the thing is that other there", "yy": "der die das und nicht schein", "zz": "ñandú que los cómo será"}
    rows = []
    for i in range(60):
        lang = ("xx", "yy", "zz")[i % 3]
        words = said[lang].split()
        rows.append((i, " ".join(words[(i * 7 + k * k) % len(words)] for k in range(3 + i)), lang, "s", 0))
    extra = [(100, None, "xx", "s", 0), (101, "", "yy", "s", 0), (102, "42 !", None, "s", 0), (None, "the thing", "xx", "s", 0), (103, "Ωμέγα", None, "s", 0), (104, "der die", None, None, None), (5, rows[5][1], rows[5][2], "s", 0), (105, "the " * 50_000, None, "s", 0)]
    return rows + extra


def test_languages_against_brute_force(spark):
    rows, size = language_rows(), 40
    learned: dict[str, Counter] = {}
    for i, text, lang in {(r[0], r[1], r[2]) for r in rows}:
        if i is not None and lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            learned.setdefault(lang, Counter()).update(brute_grams(text))
    lists = {lang: brute_top(c, size) for lang, c in learned.items()}
    df = clashing(spark, rows)
    found = rank_profiles.identify(df, rank_profiles.learn(df, size)).collect()
    want = []
    for i, text, *_ in rows:
        lang, score = brute_judge(text, lists, size)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, lang, round(score, 9)))
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in found), key=repr) == sorted(want, key=repr)
    of = {r.doc_id: r for r in found}
    assert [of[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert (of[103].lang_pred, of[103].score) == ("xx", 0.0)
    assert of[105].lang_pred == "xx"


def test_language_sample_is_bounded_and_ignores_held_out_rows(spark):
    df = spark.createDataFrame(language_rows(), DOCS)
    sample = rank_profiles.learning_sample(df, per_language=4).collect()
    assert Counter(r.lang for r in sample) == {"xx": 4, "yy": 4, "zz": 4}
    poisoned = [(i, t if zlib.crc32(str(i).encode()) % 3 != 1 else "qqq zzz", *rest) for i, t, *rest in language_rows()]
    one, two = rank_profiles.learn(df), rank_profiles.learn(spark.createDataFrame(poisoned, DOCS))
    assert one.languages == two.languages and (one.grams == two.grams).all() and (one.ranks == two.ranks).all()


def test_no_language_and_empty_tables(spark):
    none = spark.createDataFrame([(3, "some words", None, None, None)], DOCS)
    assert [tuple(r)[2:] for r in rank_profiles.identify(none, rank_profiles.learn(none)).collect()] == [("und", 0.0)]
    empty = spark.createDataFrame([], DOCS)
    assert rank_profiles.identify(empty, rank_profiles.learn(empty)).count() == 0
    one = spark.createDataFrame([(i, "only this", "xx", None, None) for i in range(9)], DOCS)
    assert {r.lang_pred for r in rank_profiles.identify(one, rank_profiles.learn(one)).collect()} == {"xx"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = rank_profiles.identify(docs, rank_profiles.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 250
    assert sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found)


# Search


def brute_search(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    counted = [Counter(terms(d[1])) for d in docs]
    total, length = sum(bool(c) for c in counted), sum(c.total() for c in counted)
    df = Counter(t for c in counted for t in c)
    asked: dict = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms(text))
    found = []
    for item, query in asked.items():
        scores = []
        for d, c in zip(docs, counted, strict=True):
            m = 100 - 25 + (25 * c.total() * total) // max(length, 1)
            s = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in query.items() if c[t])
            if s > 0:
                scores.append((-s, d[0] is None, d[0]))
        found += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(found, key=repr)


ITEMS = [(1, prose(1, 30)), (2, "w1 w1 W2 nowhere"), (3, None), (4, ""), (5, "one"), (5, "one"), (5, "three w7"), (None, "w9 w10"), (6, "テキスト é"), (7, "a"), (8, prose(2, 60).upper())]


@pytest.mark.parametrize("limits", [{}, {"VOCABULARY": 0, "QUERY_BLOCK": 20, "ADDENDS": 7, "CELLS": 10, "_LONG_TEXT": 5}])
def test_search_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(impact_search, name, value)
    docs = odd_documents() + [doc(100 + i, prose(i % 25, 20 + i % 9)) for i in range(90)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'own' term", "1 score", "2 df", "3 item")
    for k in (20, 2):
        found = impact_search.search(clashing(spark, docs).repartition(5), items, k).collect()
        assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=repr) == brute_search(docs, ITEMS, k)


def test_search_ties_at_the_last_rank(spark):
    docs = [doc(i, "same words here") for i in range(80, 0, -1)] + [doc(200, "other text")]
    found = impact_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "same")], "item_id long, text string")).collect()
    assert sorted((r["rank"], r.doc_id) for r in found) == [(i, i) for i in range(1, 21)]


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame(odd_documents(), DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert impact_search.search(docs.where("false"), items).count() == 0
    assert impact_search.search(docs, items.where("false")).count() == 0
    assert impact_search.search(docs.where("text is null"), items.where("text is null")).count() == 0


def test_bounds_hold(spark):
    docs = spark.createDataFrame([doc(i, prose(i, 10 + 37 * i)) for i in range(40)], DOCS)
    index = impact_search.build(docs)
    for r in index.table.collect():
        for impact, tf in zip(r.impacts, r.tfs, strict=True):
            exact = (1_000_000_000 * tf) // (1000 * tf + 12 * r.m)
            assert (impact + 127) * impact_search.STEP < exact <= (impact + 128) * impact_search.STEP


# Audit


def brute_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    first: dict[str, int] = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((lang or "", {f for f, yes in fails.items() if yes}, any(x[0] == i and x[1] == 1 for x in labels if i is not None), any(x[0] == i and x[2] == 1 for x in labels if i is not None)))
    found = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        walked, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                shapley[f] += len(gone)
                walked.append(("".join(order), step, f, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        found += [(part, o, s, *rest, shapley[f]) for o, s, f, *rest in walked]
    return sorted(found)


LABELS = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 0, 1), (7, 1, None), (None, 1, 1), (13, None, 1), (15, 1, 1), (18, 1, 0), (999, 1, 1)]


def test_audit_against_brute_force(spark):
    capitals, marks = prose(9, 300).upper(), " ".join(f"u{i}#" for i in range(150))
    docs = odd_documents() + [(30, capitals, "fr", "s", 0), (31, capitals, None, "s", 0), (30, capitals, "de", "s", 0), (29, marks, "de", "s", 0), (40, marks, "de", "s", 0), (40, marks, "de", "s", 0), (41, marks, "", "s", 0), (50, " ".join(f"v{i}" for i in range(120)), "de", "s", 0)]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'own' part", "1 n", "2 good")
    found = filter_audit.audit(clashing(spark, docs).repartition(7), labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == brute_audit(docs, LABELS)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame(odd_documents(), DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == brute_audit(odd_documents(), [])


def test_survivors_come_from_the_cube(spark):
    counted = spark.createDataFrame([("x", True, False, False, False, False, 3, 1, 0), ("x", False, True, False, False, True, 4, 0, 2), ("y", False, False, False, False, False, 5, 5, 0)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, n long, n_good long, n_toxic long")
    left = {(r.part, r.subset): (r.kept, r.good, r.toxic) for r in filter_audit.survivors(counted).collect()}
    assert len(left) == 64
    assert left["x", 0] == (7, 1, 2) and left["x", 1] == (4, 0, 2) and left["x", 2] == (3, 1, 0) and left["x", 31] == (0, 0, 0)
    assert left["y", 31] == (5, 5, 0)
