"""Language, semantic signals, facts and deterministic renderings: native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kunits.functions.text import CONTROL, ascii_edges, unique_first

#: Semantic kinds in order of declaration, each with its patterns (fixed values).
SIGNALS: dict[str, tuple[str, ...]] = {
    "requirement": (r"必须|应当|不得|须|shall|must|required|しなければならない|すること|必須|禁止|べき",),
    "decision": (r"决定|决议|批准|同意|确定|adopted|approved|決定|決議|承認|合意",),
    "action": (r"责任人|负责人|待办|完成日期|行动项|follow[- ]?up|action|担当者|対応事項|期限",),
    "process": (r"流程|程序|步骤|审批|process|procedure|工程|手順|承認フロー",),
    "method": (r"方法|工艺|做法|施工方案|method|technique|工法|施工方法",),
    "parameter": (r"\d+(?:\.\d+)?\s*(?:mm|cm|m|kg|t|mpa|%|元|万元|天|日|小时)\b", r"型号|规格|参数|阈值|允许偏差"),
    "risk": (r"风险|隐患|可能导致|应急|risk|hazard|リスク|危険",),
    "issue": (r"问题|缺陷|争议|未解决|issue|defect|問題|不具合|未解決",),
    "experience": (r"经验|教训|复盘|建议|lesson|retrospective|経験|教訓|振り返り",),
    "commercial_term": (r"报价|付款|合同价|税率|保函|索赔|违约|payment|price|contract|見積|支払|契約|違約",),
    "schedule": (r"进度|工期|里程碑|开工|完工|计划日期|schedule|milestone|日程|工期|着工|完了",),
    "entity_profile": (r"客户|业主|供应商|分包商|公司|联系人|client|supplier|顧客|発注者|会社|担当者",),
    "correspondence": (r"发件人|收件人|主题|抄送|函|回复|from:|to:|subject:|差出人|宛先|件名|返信",),
}
#: All semantic kinds (fixed values).
SEMANTIC_KINDS = ("fact", *SIGNALS)
#: Business domains and their patterns (fixed values).
DOMAINS = (
    ("质量", r"质量|验收|quality"), ("安全", r"安全|事故|safety"), ("成本", r"报价|成本|造价|price|cost"), ("时间", r"进度|工期|schedule"),
    ("合同", r"合同|索赔|contract"), ("采购", r"采购|供应商|procurement|supplier"), ("技术", r"技术|施工|设计|工艺|technical|design"),
)
LIFECYCLES = (("completed", r"已完成|竣工|归档|终止|取消|completed|archived|cancelled"), ("active", r"投标|询价|澄清|报价|施工中|bidding|tender|active"))
AUTHORITIES = (("formal", r"签发|批准|合同|法定|正式|approved|executed"), ("confirmed", r"会议纪要|确认|confirmed"))
RESTRICTED = r"机密|保密|内部使用|confidential"
#: Fact patterns (fixed values). The unit list tries ``m`` before ``mpa``: "5 MPa" gives "5 M".
NUMBER = r"-?\d+(?:\.\d+)?\s*(?:mm|cm|m|kg|t|mpa|%|元|万元|天|日|小时)?"
NUMBER_WHOLE_UNITS = r"-?\d+(?:\.\d+)?\s*(?:mpa|mm|cm|kg|m|t|%|万元|元|天|日|小时)?"
DATE = r"\b(?:20\d{2}[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?|\d{1,2}月\d{1,2}日)\b"
MODEL = r"\b[A-Z]{1,5}[-_/]?\d{2,}[A-Z0-9-]*\b"
STANDARD = r"\b(?:ISO|IEC|JIS|GB|EN|ASTM|DIN)[ -]?[A-Z0-9./:-]+\b"
NAME = r"\b[A-Z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)+\b"
#: Renderings into Chinese in order (fixed values); negative forms go first, else they could never match.
RENDERINGS = (
    (r"(?i)\bshall not\b|\bmust not\b|\bprohibited\b", "不得"), (r"(?i)\bshall\b|\bmust\b|\brequired to\b", "必须"),
    (r"(?i)\bshould\b", "宜"), (r"(?i)\bmay\b", "可以"),
    (r"してはならない|禁止", "不得"), (r"しなければならない|すること|必須", "必须"), (r"望ましい|べき", "宜"), (r"してもよい|可能", "可以"),
    (r"(?i)\brequirement(s)?\b", "要求"), (r"(?i)\brisk(s)?\b", "风险"), (r"(?i)\bdecision(s)?\b", "决策"), (r"(?i)\baction item(s)?\b", "行动项"),
    (r"(?i)\bschedule\b", "计划"), (r"(?i)\bmethod\b", "方法"), (r"(?i)\bprocess\b", "流程"),
    (r"要求事項", "要求"), (r"リスク", "风险"), (r"決定事項", "决策"), (r"対応事項", "行动项"), (r"工程", "流程"), (r"方法", "方法"),
)


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of the text by script: what the text loses without them."""
    count = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, f"{pattern}+", ""))
    ascii_alone = F.octet_length(text) == F.char_length(text)
    other = lambda pattern: F.when(ascii_alone, 0).otherwise(count(pattern))
    return {"han": other(r"\p{IsHan}"), "hiragana": other(r"\p{IsHiragana}"), "katakana": other(r"\p{IsKatakana}"), "latin": count("[A-Za-z]")}


def _language_of(han: Column, kana: Column, latin: Column) -> Column:
    ja, zh, en = kana >= 2, han >= 2, latin >= 4
    return F.when((ja & en) | (en & zh & ~ja), "mixed").when(ja, "ja").when(zh, "zh").when(en, "en").otherwise("unknown")


def detect_language(text: Column) -> Column:
    """struct(language, confidence, script_evidence): zh, ja, en, mixed or unknown from script counts."""
    c = script_counts(text)
    kana, total = c["hiragana"] + c["katakana"], c["han"] + c["hiragana"] + c["katakana"] + c["latin"]
    share = F.greatest(c["han"], kana, c["latin"]) / F.greatest(total, F.lit(1))
    confidence = F.when(total > 0, F.least(F.lit(0.99), F.lit(0.55) + share * 0.44)).otherwise(F.lit(0.0))
    return F.struct(_language_of(c["han"], kana, c["latin"]).alias("language"), confidence.alias("confidence"), F.struct(*(v.alias(k) for k, v in c.items())).alias("script_evidence"))


#: Scripts that decide the dominant language, in order of preference among equals (fixed values).
DOMINANT = (("ja", r"[\p{IsHiragana}\p{IsKatakana}]"), ("ko", r"\p{IsHangul}"), ("zh", r"\p{IsHan}"), ("ru", r"\p{IsCyrillic}"), ("ar", r"\p{IsArabic}"), ("th", r"\p{IsThai}"), ("hi", r"\p{IsDevanagari}"), ("en", r"[A-Za-z]"))


def dominant_language(text: Column) -> Column:
    """The language whose script has most characters; kana at all make it Japanese rather than Chinese."""
    counts = [(name, F.regexp_count(text, F.lit(pattern))) for name, pattern in DOMINANT]
    scored = [F.struct((n + (counts[2][1] if name == "ja" else F.lit(0)) * (counts[0][1] > 0).cast("int")).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, n) in enumerate(counts)]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise("unknown")


def _ascii_lower(text: Column) -> Column:
    """A-Z in lower case, for literals in lower case; the two other characters whose lower case has an ASCII letter go first."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\0")), F.lit("\u0130"), F.lit("\0")))


def _occurs(text: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern occurs in any case; *low*: what :func:`_with_lower` has of the text.

    Alternatives that are plain literals are looked up as such: a pattern
    tries every one of them at every character. Those of Han or kana are only
    looked for in texts that have any; what is no literal, where its beginning is.
    """
    parts = [] if re.search(r"[()\\]", pattern) else pattern.split("|")
    plain = [p for p in parts if not re.search(r"[\[\]?*+.{}^$]", p)]
    rest = "|".join(p for p in parts if p not in plain) if parts else pattern
    either = lambda found: reduce(lambda a, b: a | b, found)
    wide, narrow = ([F.contains(low["text"], F.lit(p.lower())) for p in plain if bool(re.search(WIDE, p)) == is_wide] for is_wide in (True, False))
    found = [*([low["wide"] & either(wide)] if wide else []), *narrow]
    if rest:
        start = re.match(r"[a-z]+(?![a-z?*{])", rest)
        there = text.rlike("(?i)" + ascii_edges(rest))
        found.append(F.contains(low["text"], F.lit(start[0])) & there if start and "|" not in rest else there)
    return either(found)


#: Characters of Han and kana: literals that have one are only looked for in texts that have one.
WIDE = "[\u3041-\u30ff\u4e00-\u9fff]"


def _with_lower(text: Column, then: Callable[[Column], Column]) -> Column:
    """*then* of a struct, made once: the text from :func:`_ascii_lower`, and whether it has Han or kana (wide)."""
    wide = (F.octet_length(text) != F.char_length(text)) & text.rlike(WIDE)
    return F.get(F.transform(F.array(F.struct(_ascii_lower(text).alias("text"), wide.alias("wide"))), then), 0)


def _signal(text: Column, low: Column, kind: str) -> Column:
    return sum((_occurs(text, low, p).cast("int") for p in SIGNALS[kind]), F.lit(0))


def signal(text: Column, kind: str) -> Column:
    """Score of a semantic kind: how many of its patterns occur, in any case."""
    return _with_lower(text, lambda low: _signal(text, low, kind))


def semantic_signals(text: Column) -> Column:
    """struct of the scores of all kinds; the text is put in lower case once."""
    return _with_lower(text, lambda low: F.struct(*(_signal(text, low, k).alias(k) for k in SIGNALS)))


def ranked_kinds(signals: Column) -> Column:
    """Kinds of positive score, best first, equals in order of declaration."""
    scored = F.array(*(F.struct((-signals[k]).alias("score"), F.lit(i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(SIGNALS)))
    return F.transform(F.filter(F.array_sort(scored), lambda s: s["score"] < 0), lambda s: s["kind"])


def dominant_kind(text: Column) -> Column:
    """The best kind, ``fact`` without any signal. Only ``parameter`` can score two.

    The text is put in lower case once; kinds are tried in turn, none after the one that is there.
    """
    return _with_lower(text, lambda low: kind_of({k: _signal(text, low, k) for k in SIGNALS}))


def kind_of(signals: Column | dict[str, Column]) -> Column:
    """The best kind of the scores from :func:`semantic_signals`, as :func:`dominant_kind`."""
    chain = F.when(signals["parameter"] == 2, "parameter")
    for kind in SIGNALS:
        chain = chain.when(signals[kind] > 0, kind)
    return chain.otherwise("fact")


def domains(text: Column) -> Column:
    return _with_lower(text, lambda low: F.array_compact(F.array(*(F.when(_occurs(text, low, p), tag) for tag, p in DOMAINS))))


def first_of(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    def first(low: Column) -> Column:
        found = F.lit(otherwise)
        for name, pattern in reversed(rules):
            found = F.when(_occurs(text, low, pattern), name).otherwise(found)
        return found

    return _with_lower(text, first)


def _extract(text: Column, pattern: str, most: int | None = None, case: bool = True, first: str = "", longest: int | None = 160) -> Column:
    r"""Distinct matches in order. *first*: the class of characters that a match starts with, where the pattern starts
    with ``\b``: it is looked at before the character in front of it, so most places are left at once."""
    edged = f"(?={first})(?<![A-Za-z0-9_])" + pattern.removeprefix(r"\b") if first else pattern
    found = F.regexp_extract_all(text, F.lit(("" if case else "(?i)") + ascii_edges(edged)), F.lit(0))
    found = found if most is None else F.slice(found, 1, most)
    bare = lambda v: F.trim(F.regexp_replace(v, CONTROL, ""))
    return unique_first(F.transform(found, bare if longest is None else lambda v: F.substring(bare(v), 1, longest)))


def extract_numbers(text: Column, whole_units: bool = False) -> Column:
    return _extract(text, NUMBER_WHOLE_UNITS if whole_units else NUMBER, 20, case=False)


def extract_dates(text: Column) -> Column:
    return _extract(text, DATE, 10, first="[0-9]")


def extract_models(text: Column) -> Column:
    return _extract(text, MODEL, 10, first="[A-Z]")


def extract_facts(text: Column, whole_units: bool = False) -> Column:
    """struct(numbers, dates, models): distinct in order of appearance, of at most 20, 10 and 10 matches."""
    return F.struct(extract_numbers(text, whole_units).alias("numbers"), extract_dates(text).alias("dates"), extract_models(text).alias("models"))


def protected_tokens(text: Column) -> Column:
    """What a translation must keep: all numbers, dates, models, standards and hyphenated names, each whole."""
    kinds = ((NUMBER, False, ""), (DATE, True, "[0-9]"), (MODEL, True, "[A-Z]"), (STANDARD, False, "[ADEGIJ]"), (NAME, True, "[A-Z]"))
    return F.array_distinct(F.concat(*(_extract(text, pattern, case=case, first=first, longest=None) for pattern, case, first in kinds)))


def _words(pattern: str) -> list[str]:
    """The words of a rendering's pattern, without endings that may be missing."""
    return [re.sub(r"\\b|\(s\)\?", "", word) for word in pattern.removeprefix("(?i)").split("|")]


def _bare_edges(pattern: str) -> str:
    r"""The pattern with each ``\b`` beside a word as a look at the one character outside of it."""
    return re.sub(r"\\b(?=[a-z])", "(?<![A-Za-z0-9_])", pattern).replace(r"\b", "(?![A-Za-z0-9_])")


def deterministic_chinese(text: Column) -> Column:
    """struct(text, safe): ordered renderings; safe if anything changed and the rest is not foreign."""

    def rendered(out: Column, low: Column, rule: Column) -> Column:
        # A pattern is only run where one of its words is. No rendering makes an English word; some make words of later patterns.
        there = F.exists(rule["words"], lambda w: F.contains(F.when(rule["any_case"], low).otherwise(out), w))
        return F.when(there, F.regexp_replace(out, rule["pattern"], rule["replacement"])).otherwise(out)

    rules = F.array(*(
        F.struct(F.lit(p.startswith("(?i)")).alias("any_case"), F.array(*map(F.lit, _words(p))).alias("words"), F.lit(_bare_edges(p)).alias("pattern"), F.lit(r).alias("replacement"))
        for p, r in RENDERINGS
    ))
    out = _with_lower(text, lambda low: F.aggregate(rules, text, lambda out, rule: rendered(out, low["text"], rule)))
    safe = F.get(F.transform(F.array(out), lambda o: (o != text) & ~detect_language(o)["language"].isin("ja", "en", "mixed")), 0)
    return F.struct(out.alias("text"), safe.alias("safe"))


def translation_problem(source: Column, translated: Column) -> Column:
    """Null, TRANSLATION_NOT_CHINESE or TRANSLATION_FIDELITY_INVALID."""
    found = detect_language(translated)
    lost = ~F.forall(protected_tokens(source), lambda t: F.contains(translated, t))
    foreign = (F.coalesce(translated, F.lit("")) == "") | found["language"].isin("ja", "en") | (found["script_evidence"]["han"] < 2)
    return F.when(foreign, "TRANSLATION_NOT_CHINESE").when(lost, "TRANSLATION_FIDELITY_INVALID")
