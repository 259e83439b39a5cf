"""Text normalisers, hashes and redaction as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = r"[\x00-\x1f\x7f]"
#: A word boundary of ASCII word characters, whatever the script around it.
ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with every ``\b`` as an ASCII boundary."""
    return pattern.replace(r"\b", ASCII_EDGE)


#: Texts of a batch that are Python strings at a time.
TEXTS_AT_ONCE = 256


#: Characters that NFKC leaves as they are, whatever stands beside them (fixed values): ASCII, Latin letters, Cyrillic, kana, Han and marks.
STABLE = r"\x00-\x7f\u00c0-\u00ff\u0400-\u045f\u2013\u2014\u2018-\u201e\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fff"


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    pieces = (values.slice(at, TEXTS_AT_ONCE) for at in range(0, len(values), TEXTS_AT_ONCE))
    normal = [p if p.null_count == len(p) else pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in p.to_pylist()], values.type) for p in pieces]
    return pa.concat_arrays(normal) if normal else values


def nfkc(column: Column) -> Column:
    """Unicode NFKC; Spark has no native function for it. Only texts that it may change go to Python, a few at a time."""
    plain = (F.octet_length(column) == F.char_length(column)) | column.rlike(rf"\A[{STABLE}]*+\z")
    return F.when(plain, column).otherwise(_nfkc(F.when(~plain, column)))


def clean(column: Column, most: int = 8000, normal: bool = True) -> Column:
    """NFKC unless *normal* is off, without control characters (newlines too), trimmed, cut; null is empty."""
    text = F.coalesce(column, F.lit(""))
    return F.substring(F.trim(F.regexp_replace(nfkc(text) if normal else text, CONTROL, "")), 1, most)


def clean_writer(column: Column, most: int = 500) -> Column:
    """Trimmed, without control characters, cut."""
    return F.substring(F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), CONTROL, ""), 1, most)


def clean_text(column: Column, most: int = 1000) -> Column:
    """Trimmed, white space runs as one space, cut."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " ")), 1, most)


def verbatim(column: Column, most: int = 2000) -> Column:
    """Trimmed of white space and cut, otherwise as it is."""
    return F.substring(F.regexp_replace(F.coalesce(column, F.lit("")), r"^\s+|\s+$", ""), 1, most)


def identity_key(column: Column, normal: bool = True) -> Column:
    """Key under which spellings of a name are equal."""
    text = clean_text(column, 500)
    return F.regexp_replace(F.lower(nfkc(text) if normal else text), r"[\s\-_.:/\\()\[\]{}]+", "")


def unique_sorted(values: Column) -> Column:
    """Trimmed, non-empty, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))))


def unique_first(values: Column, most: int | None = None) -> Column:
    """Distinct non-empty values in order of first appearance."""
    kept = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    return kept if most is None else F.slice(kept, 1, most)


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def json_text(column: Column) -> Column:
    """A JSON string literal of a text."""
    return F.substring(F.to_json(F.array(column)), F.lit(2), F.length(F.to_json(F.array(column))) - 2)


def stable_json(**members: Column) -> Column:
    """A JSON object with sorted keys; values are JSON texts."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(members.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Content-addressed id: 24 hex digits of the parts joined by U+241F."""
    return F.concat(F.lit(prefix + "-"), F.substring(digest(F.concat_ws("␟", *(F.coalesce(p, F.lit("")) for p in parts))), 1, 24))


def safe_slice(column: Column, start: Column | int, length: Column | int) -> Column:
    """Characters from *start* (0 first); never half a surrogate pair, as Spark counts code points."""
    begin = (F.lit(start) if isinstance(start, int) else start) + 1
    return F.substring(column, begin, F.lit(length) if isinstance(length, int) else length)


#: Redactions in order: pattern, replacement (fixed values).
REDACTIONS = (
    (r"(?i)\b(authorization|x-api-key|api-key|cookie|set-cookie)(\s*[:=]\s*)[^\r\n,;]+", "$1$2[REDACTED]"),
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 [REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}", "[REDACTED_JWT]"),
    (r"(?i)([?&](?:access_token|token|api_key|apikey|key|secret|signature|sig|password)=)[^&#\s]+", "$1[REDACTED]"),
    (r"(?i)\b(api[_-]?key|secret|password|passwd|token)(\s*[:=]\s*)[\"']?[A-Za-z0-9._~+/-]{6,}[\"']?", "$1$2[REDACTED]"),
)


def redact(column: Column) -> Column:
    """Secrets in headers, bearer tokens, JWTs, URL parameters and assignments are masked."""
    for pattern, replacement in REDACTIONS:
        column = F.regexp_replace(column, pattern, replacement)
    return column


def strip_html(column: Column, native: bool = False) -> Column:
    """Text of markup: scripts, styles and comments go first, tags become spaces, entities are decoded.

    *native* decodes the common named entities only, without Python.
    """
    bare = F.regexp_replace(F.coalesce(column, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    decoded = decode_entities_native(bare) if native else F.translate(decode_entities(bare), "\xa0", " ")
    return F.trim(F.regexp_replace(decoded, r"\s+", " "))


#: Entities that are decoded natively (fixed values); ``&amp;`` last.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&"))


def decode_entities_native(column: Column) -> Column:
    """The common named entities, without Python."""
    for name, sign in NAMED:
        column = F.replace(column, F.lit(name), F.lit(sign))
    return column


def _entity(m: re.Match) -> str:
    body = m[1]
    if body[0] != "#":
        return html.entities.html5.get(body + ";", m[0])
    number = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    return m[0] if 0xD800 <= number <= 0xDFFF or number > 0x10FFFF or not number else chr(number)


@F.pandas_udf(T.StringType())
def decode_entities(values: pd.Series) -> pd.Series:
    """All named, decimal and hexadecimal entities; unknown names and surrogates stay."""
    return values.map(lambda v: v if v is None or "&" not in v else re.sub(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", _entity, v))


def attachment_name(column: Column) -> Column:
    """A file name without folders, control characters and characters that file systems refuse."""
    base = F.regexp_replace(F.coalesce(column, F.lit("")), r"^.*[\\/]", "")
    kept = F.regexp_replace(F.regexp_replace(base, CONTROL, ""), r'[:*?"<>|]', "_")
    kept = F.regexp_replace(kept, r"^[. ]+|[. ]+$", "")
    return F.when(kept == "", F.lit("attachment")).otherwise(F.substring(kept, 1, 180))


def safe_segment(column: Column) -> Column:
    """A path segment: refused characters become dashes; empty is the untitled one."""
    text = F.regexp_replace(clean_writer(column, 120), r'[\\/:*?"<>|#\[\]^]', "-")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.\.", "-"), r"\s+", " "), r"^[. ]+|[. ]+$", "")
    return F.when(text == "", F.lit("未命名")).otherwise(text)


def path_safe(column: Column) -> Column:
    """Whether a path is relative, has no empty or dot segments and no refused characters."""
    raw = F.regexp_replace(clean_writer(column, 1000), r"\\", "/")
    bare = F.regexp_replace(raw, r"/+$", "")
    bad = (raw == "") | raw.startswith("/") | raw.rlike(r"^[A-Za-z]:/") | (bare == "") | bare.rlike(r"(^|/)(\.{0,2})(/|$)") | bare.rlike(r'[\x00-\x1f\x7f:*?"<>|]')
    return ~bad


def front_value(content: Column, key: str) -> Column:
    """Value of a front-matter key, '' where it is missing."""
    return F.trim(F.regexp_extract(F.coalesce(content, F.lit("")), rf"(?m)^{key}:\s*[\"']?([^\"'\n]+)", 1))


def has_source(content: Column, source: Column) -> Column:
    """Whether a record's text names the source as owner or in its list of sources."""
    text = F.coalesce(content, F.lit(""))
    listed = F.regexp_extract(text, r"(?m)^source_document_ids:\s*\[([^\n]*)", 1)
    return F.contains(text, F.concat(F.lit("- 归属来源："), source)) | F.contains(listed, source)


def pseudonym(column: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), column).cast("binary"), 256)


def legacy_id(prefix: str, column: Column, place: Column) -> Column:
    """Slug of a value after a prefix; its place (from 1) where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), r"[^A-Za-z0-9._:-]+", "-"), r"^-+|-+$", "")
    return F.concat(F.lit(prefix + ":"), F.when(slug == "", place.cast("string")).otherwise(slug))
