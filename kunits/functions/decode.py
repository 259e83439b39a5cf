"""Bytes to text, mail encodings and JSON repair: Arrow-batched functions, since Spark has no native ones."""

from __future__ import annotations

import json
import quopri
import re
from email.header import decode_header, make_header

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings tried in order when bytes aren't UTF-8 (fixed values).
CANDIDATES = ("gb18030", "euc_kr", "shift_jis", "cp1252")
#: First bytes of files that aren't text (fixed values).
MAGIC = (b"PK\x03\x04", b"%PDF", b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"\xd0\xcf\x11\xe0", b"\x7fELF", b"\x1f\x8b")
FLOOR = -0.15
#: Characters that real text in Chinese and Korean is full of (fixed values).
COMMON = tuple(
    "的一是不了在有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处理府究观越织装影算低持音众书布复容儿须际商非验连断深难近矿千周委素技备半办青省列习响约支般史感劳便团往酸历市克何除消构府称太准精值号率族维划选标写存候毛亲快效斯院查江型眼王按格养易置派层片始却专状育厂京识适属圆包火住调满县局照参红细引听该铁价严"
    "이가는을를에의다고하지로은도서한인사기자어나리시대해정아일수만보들라스국장입니문그것전제여"
)


def readability(text: str) -> float:
    """From about -1 to 1: letters of scripts in use count for, odd and control characters against."""
    if not text:
        return 0.0
    good = len(re.findall(r"[\w\s.,;:!?()\-'\"%/，。、；：！？（）《》「」]", text))
    common = sum(map(text.count, COMMON)) + len(re.findall(r"[\u3041-\u30f6]|[A-Za-z]{2,}", text))
    odd = len(re.findall(r"[\ufffd\ue000-\uf8ff]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|[\u00c3\u00c2][\u0080-\u00bf]|[\u3400-\u4dbf\uf900-\ufaff]", text))
    odd += max(0, len(re.findall(r"[\u00a1-\u00ff]", text)) - len(text) // 3) / 2  # Latin text is mostly ASCII
    return good / len(text) - 1 + 0.5 * min(1.0, 2 * common / len(text)) - 3 * odd / len(text) + 0.2


def decode_bytes(data: bytes | None) -> tuple[str | None, str, float]:
    """(text, encoding, score); no text for files of other kinds and for bytes that read badly in all encodings."""
    if data is None:
        return None, "none", 0.0
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, errors="replace"), name, 1.0
    if data.startswith(MAGIC):
        return None, "binary", -1.0
    try:
        text = data.decode("utf-8")
        if "\x00" not in text:
            return text, "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    tries = list(CANDIDATES)
    if len(data) > 3 and data.count(0) > len(data) / 5:
        tries = ["utf-16-le" if data[1:400:2].count(0) >= data[0:400:2].count(0) else "utf-16-be"]
    found = []
    for i, name in enumerate(tries):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            if name != "cp1252":
                continue
            text = data.decode(name, errors="replace")
        found.append((readability(text), -i, text, name))
    if not found:
        return None, "unknown", -1.0
    score, _, text, name = max(found)
    return (text, name, score) if score >= FLOOR else (None, "unknown", score)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("score", T.DoubleType())]))
def decode_text(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(bytes(b) if b is not None else None) for b in content], columns=["text", "encoding", "score"])


@F.pandas_udf(T.StringType())
def quoted_printable(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else quopri.decodestring(v.encode()).decode(errors="replace"))


@F.pandas_udf(T.StringType())
def mime_words(values: pd.Series) -> pd.Series:
    """RFC 2047 words decoded, neighbours joined; what doesn't decode stays."""

    def one(v: str | None) -> str | None:
        if v is None or "=?" not in v:
            return v
        try:
            return str(make_header(decode_header(v)))
        except (LookupError, ValueError):
            return v

    return values.map(one)


def repair(text: str | None) -> str | None:
    """JSON of a nearly valid text: fences and trailing commas go, open strings and brackets are closed; null if it still fails."""
    if text is None:
        return None
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text).strip()
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    out, stack, inside, escaped = [], [], False, False
    for c in body[start:]:
        if inside:
            out.append(c)
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
            continue
        if c in "}]":
            while out and out[-1] in ", \n\t\r":
                out.pop()
            if not stack:
                break
            while stack and stack[-1] != c:
                out.append(stack.pop())
            if stack:
                out.append(stack.pop())
            if not stack:
                break
            continue
        if c in "{[":
            stack.append("}" if c == "{" else "]")
        inside = c == '"'
        out.append(c)
    if inside:
        out.append('"')
    while out and out[-1] in ", \n\t\r":
        out.pop()
    made = "".join(out) + "".join(reversed(stack))
    for attempt in (made, re.sub(r',?\s*"[^"]*"\s*:?\s*(?=[}\]]*$)', "", made)):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repair_json(values: pd.Series) -> pd.Series:
    return values.map(repair)
