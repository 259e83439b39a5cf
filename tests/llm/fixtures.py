"""Small tables with every odd case, and brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = ("node", "label", "key", "mark", "places", "runs", "doc", "text_key", "score", "predicted", "n_words", "n_removed", "words_before", "stat_log_chars", "kept_id", "ids", "rank", "tokens", "class_id", "rest", "Text_Key")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(w + ("," if r.random() < 0.1 else "") for w in words)


def doc(i: int | None, text: str | None) -> tuple:
    return (i, text, "en", "src0", None if text is None else len(text))


def odd_documents() -> list[tuple]:
    """Nulls, empties, repeated rows, copies, near copies, long texts, shared passages."""
    base, passage = prose(1, 120), prose(2, 60)
    edited = base.split()
    edited[50] = "changed"
    return [
        doc(1, base), doc(2, base), doc(3, " ".join(edited)), doc(4, None), doc(5, ""), doc(6, "   \n\t "), doc(7, "one"), doc(7, "one"), doc(8, "one two three"), doc(None, base), doc(None, None),
        doc(9, prose(3, 30) + "\n" + passage + "\n" + prose(4, 30)), doc(10, prose(5, 50) + " " + passage), doc(11, prose(6, 4000)), doc(12, "é" * 3000), doc(13, "a " * 500), doc(14, "日本語 の テキスト 🙂 " * 10),
        doc(15, passage.upper()), doc(16, "\x00 odd\x0bspace\u00a0here"), (17, "text with null columns", None, None, None), doc(18, passage), doc(18, passage + " tail"),
    ]


def clashing(spark, rows: list[tuple]):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    seen: set[str] = {c.lower() for c in df.columns}
    for c in CLASH:
        if c.lower() not in seen:
            df = df.withColumn(c, F.lit(f"own {c}"))
            seen.add(c.lower())
    return df


def labelled_kmers(text: str | None) -> Counter:
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def classes(docs: list[tuple]) -> dict[int, int]:
    """Row index to class: equal texts and texts of similarity 0.8, by an ordered alignment."""
    parent = list(range(len(docs)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    def sequence(text: str) -> list:
        words = re.findall(r"[^\W_]+", text.lower())
        grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        seen: Counter = Counter()
        out = []
        for g in grams:
            out.append((g, seen[g]))
            seen[g] += 1
        return out

    def common(a: list, b: list) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    made = [sequence(d[1]) if d[1] else [] for d in docs]
    for i in range(len(docs)):
        for j in range(i):
            if not docs[i][1] or not docs[j][1]:
                continue
            same = docs[i][1] == docs[j][1]
            if not same and made[i] and made[j] and min(len(made[i]), len(made[j])) >= 0.8 * max(len(made[i]), len(made[j])):
                m = common(made[i], made[j])
                same = m >= 0.8 * (len(made[i]) + len(made[j]) - m)
            if same:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(docs))}


def kept_words(docs: list[tuple], window: int = 20) -> list[tuple[int, int, list[str]]]:
    """(words, removed, kept words) of each row: windows that also start earlier go."""
    late = 2**63 - 1
    split = [re.findall(r"[^\x20\x09-\x0d]+", d[1] or "") for d in docs]
    first: dict[tuple, tuple] = {}
    for d, w in zip(docs, split, strict=True):
        for i in range(len(w) - window + 1):
            at = (late if d[0] is None else d[0], i)
            first[tuple(w[i : i + window])] = min(first.get(tuple(w[i : i + window]), at), at)
    out = []
    for d, w in zip(docs, split, strict=True):
        gone: set[int] = set()
        for i in range(len(w) - window + 1):
            if (late if d[0] is None else d[0], i) > first[tuple(w[i : i + window])]:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def hits(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    """(words, hit words, items) by the contract of decontamination."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    w = words(text)
    covered: set[int] = set()
    found: set[str] = set()
    for item, said in items:
        iw = words(said)
        size = min(10, len(iw))
        windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                covered.update(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(w), len(covered), sorted(found)
