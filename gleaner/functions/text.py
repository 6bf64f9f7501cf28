"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = "\u001f"
#: Evidence statuses, and the one older spelling.
STATUSES = ["skipped", "hit", "partial", "scope_mismatch", "no_hit", "insufficient_evidence", "unverified", "needs_clarification", "error"]
OLD_STATUSES = {"version_mismatch": "scope_mismatch"}
#: What stands for an empty section.
PLACEHOLDERS = ["无", "暂无", "无内容", "不涉及", "n/a", "-"]
KNOWN_TYPES = ["pdf", "docx", "pptx", "xlsx", "xls", "txt", "csv", "html", "json"]
#: Words after which a credential stands.
CREDENTIAL_WORDS = "api[_-]?key|password|passwd|pwd|defaultpwd|secret|client[_-]?secret|access[_-]?token|refresh[_-]?token|id[_-]?token|authorization|cookie"


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def stable_structure_id(kind: str, *parts: Column) -> Column:
    """kind:24 hex digits of the parts, whatever their case and white space."""
    joined = F.concat_ws(UNIT, *[F.lower(collapsed(F.coalesce(p.cast("string"), F.lit("")))) for p in parts])
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(joined, 256), 1, 24))


def strip_section_context(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*【[^】\n]*】[ \t]*\n*", "")


def row_cells(line: Column) -> Column:
    """Trimmed cells of a pipe row; null for separators, other lines and rows of one cell."""
    t = F.trim(line)
    inner = F.regexp_replace(F.regexp_replace(t, r"^\|", ""), r"\|$", "")
    cells = F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))
    separator = F.forall(cells, lambda x: x.rlike(r"^:?-{3,}:?$"))
    return F.when(t.startswith("|") & t.endswith("|") & (F.size(cells) >= 2) & ~separator, cells)


def matching_line(content: Column, wanted: Column, most: int = 1200) -> Column:
    """The first line that holds the wanted text, whatever the case; else the head."""
    hits = F.filter(F.split(content, "\n"), lambda x: F.lower(x).contains(F.lower(wanted)))
    return F.substring(F.when((F.size(hits) > 0) & (wanted != ""), hits[0]).otherwise(content), 1, most)


#: Fixed value: what a lookup ignores.
LOOKUP_NOISE = r"[\s\-—_·,，。!！?？:：;；、/\\()（）\[\]【】《》〈〉'\"`]+"
#: Endings that names of products and projects may carry.
PRODUCT_ENDINGS = ["platform", "system", "平台", "系统"]
PROJECT_ENDINGS = ["项目", "工程"]


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no function."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


def normalize_lookup_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), LOOKUP_NOISE, "")


def exact_source_match(query: Column, content: Column) -> Column:
    """Whether a content holds the query, whatever the width, case, spaces and punctuation."""
    wanted = normalize_lookup_text(query)
    return (wanted != "") & normalize_lookup_text(content).contains(wanted)


def bare_name(c: Column, endings: list[str]) -> Column:
    """Lower-case letters, digits and CJK; one of the endings goes, unless it is the whole name."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\x{3400}-\x{9fff}]+", "")
    out = plain
    for e in reversed(endings):
        out = F.when(plain.endswith(e) & (F.char_length(plain) > len(e)), F.substring(plain, F.lit(1), F.char_length(plain) - len(e))).otherwise(out)
    return out


def canonical_product(c: Column) -> Column:
    return bare_name(c, PRODUCT_ENDINGS)


def canonical_project(c: Column) -> Column:
    return bare_name(c, PROJECT_ENDINGS)


def extract_versions(c: Column) -> Column:
    """Numbers of one to four dotted parts, distinct, in order; leading zeros go."""
    found = F.regexp_extract_all(F.regexp_replace(c, r"[^0-9.]+", " "), F.lit(r"(?:^| )(\d{1,4}(?:\.\d{1,4}){0,3})(?= |$)"), F.lit(1))
    return F.array_distinct(F.transform(found, canonical_version))


def canonical_version(c: Column) -> Column:
    """Dotted numbers without leading zeros; anything else in lower case, without a leading `v`."""
    raw = F.regexp_replace(F.trim(c), r"(?i)^(?:版本|v)\s*", "")
    numbers = F.array_join(F.transform(F.split(raw, r"\."), lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")), ".")
    return F.when(raw.rlike(r"^\d+(?:\.\d+)*$"), numbers).otherwise(F.lower(raw))


def version_key(c: Column) -> Column:
    """Sorts dotted numbers by value."""
    return F.array_join(F.transform(F.split(c, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 10, "0"))).otherwise(F.concat(F.lit("1"), x))), UNIT)


def topic_terms(c: Column) -> Column:
    """ASCII words whole; of CJK runs the run (up to 4) and all 2- and 3-grams."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9][a-z0-9_.+/-]+|[\x{3400}-\x{9fff}]+)"), F.lit(1))

    def grams(t: Column, n: int) -> Column:
        return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def of(t: Column) -> Column:
        whole = F.when(F.length(t) <= 4, F.array(t)).otherwise(F.array().cast("array<string>"))
        return F.when(t.rlike(r"^[a-z0-9]"), F.array(t)).otherwise(F.concat(whole, grams(t, 2), grams(t, 3)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, of))))


def redact_text(c: Column) -> Column:
    """Bearer tokens, the values of credentials and the private parts of URLs go; scheme, host, port and path stay."""
    c = F.regexp_replace(c, r"(?i)\b(bearer)\s+[\w.~+/=-]+", "Bearer [REDACTED]")
    value = r"(?:\"[^\"]*\"|'[^']*'|[^\s,;\]}\"']+)"
    c = F.regexp_replace(c, rf"(?i)\b({CREDENTIAL_WORDS})([\"']?\s*[:=]\s*){value}", "$1$2[REDACTED]")
    scheme = r"(?i)([a-z][a-z0-9+.-]*://)"
    c = F.regexp_replace(c, scheme + r"[^\s/@\"'<>]*@", "$1")
    return F.regexp_replace(c, scheme + r"([^\s?#\"'<>]*)[?#][^\s\"'<>]*", "$1$2")


def preview(c: Column, most: int = 500) -> Column:
    t = collapsed(c)
    return F.when(t != "", F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t))


def content_fingerprint(c: Column) -> Column:
    return F.struct(F.char_length(c).alias("length"), F.sha2(c, 256).alias("sha256"))


def throttle_key(scope: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(scope), *[F.lower(F.trim(p)) for p in parts]), 256)


def throttle_keys(user: Column, ip: Column) -> dict[str, Column]:
    """Stable keys of the three scopes; an unknown address counts as one."""
    ip = F.coalesce(ip, F.lit("unknown"))
    return {"pair": throttle_key("pair", ip, user), "ip": throttle_key("ip", ip), "account": throttle_key("account", user)}


def file_type_from_name(file_type: Column, filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    return F.when((file_type == "md") & ext.isin(KNOWN_TYPES), ext).otherwise(file_type)


def canonical_evidence_status(c: Column) -> Column:
    s = F.lower(F.trim(c))
    for old, new in OLD_STATUSES.items():
        s = F.when(s == old, new).otherwise(s)
    return F.when(s.isin(STATUSES), s)


def normalize_tags(c: Column) -> Column:
    """Trimmed, non-empty, distinct tags of a JSON list; invalid JSON gives none."""
    tags = F.transform(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(tags, lambda x: x != ""))


def request_kind(event: Column, surface: Column) -> Column:
    return F.when(event.startswith("chat.") | (surface == "chat"), "chat").when(event.startswith("search_test.") | (surface == "search_test"), "search_test").otherwise("unknown")


def is_placeholder(text: Column) -> Column:
    """Every line that says anything is a placeholder; code and tables never are."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    protected = F.exists(lines, lambda x: x.rlike(r"^\s*(```|~~~)") | x.startswith("    ") | x.startswith("\t") | x.rlike(r"^\s*\|.*\|\s*$"))
    said = F.filter(F.transform(lines, lambda x: F.lower(F.trim(F.regexp_replace(x, r"^(?:\s*>\s*)+", "")))), lambda x: x != "")
    return (F.size(said) > 0) & ~protected & F.forall(said, lambda x: x.isin(PLACEHOLDERS))


def identity_fingerprint(*sets: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT + UNIT, *[F.array_join(F.array_sort(s), UNIT) for s in sets]), 256)


def evidence_role(role: Column, topic: Column, support: Column, status: Column, scoped: Column, contribution: Column, least: float = 0.3) -> Column:
    """What a row may count as after scope and contribution are known."""
    enough = topic >= least
    lesser = F.when(enough, "related").otherwise("irrelevant")
    first = F.when(status == "mismatch", lesser).when((status == "unknown") & scoped & (role == "direct"), "related").when((role == "direct") & (~enough | (support < least)), lesser).otherwise(role)
    return F.when(contribution == "irrelevant", "irrelevant").when(contribution.isin("bridge", "complement", "background") & (first == "direct"), lesser).otherwise(first)


def candidate_limit(k: Column, simple: bool = False) -> Column:
    """Candidates to judge for a wanted k of 1 to 20."""
    n = F.greatest(F.lit(1), F.least(F.lit(20), k))
    return F.least(F.lit(20), F.greatest(F.lit(8), 2 * n)) if simple else F.least(F.lit(30), F.greatest(F.lit(12), 3 * n))


def scope_status(target_product: Column, target_version: Column, product: Column, versions: Column, compatible: Column, unsupported: Column) -> Column:
    """exact, compatible, neutral, unknown or mismatch of a candidate with a wanted product and version."""
    none = target_product.isNull() & target_version.isNull()
    other = target_product.isNotNull() & product.isNotNull() & (product != target_product)
    declared = F.size(versions) > 0
    version = (
        F.when(target_version.isNull(), "exact").when(F.array_contains(unsupported, target_version), "mismatch").when((F.size(versions) == 1) & F.array_contains(versions, target_version), "exact")
        .when(F.array_contains(versions, target_version) | F.array_contains(compatible, target_version), "compatible").when(declared, "mismatch").otherwise("unknown")
    )
    return F.when(none, "neutral").when(other, "mismatch").when(target_product.isNotNull() & product.isNull(), "unknown").otherwise(version)


#: How support for a version is claimed and denied.
SUPPORT_WORDS = ["兼容", "支持", "适用于", "适用", "适配"]
DENIALS = ["不代表", "不再", "并不", "并非", "尚未", "尚不", "从未", "无法", "不能", "不可", "未", "不"]
#: What a sentence says of its list, by the word that tells it.  closes: the list is whole; introduces:
#: it follows; opens: it has more members; elsewhere: the rest stands in another place.
SIGNS = {
    "closes": ["仅包括", "仅包含", "仅有", "仅限于", "仅支持", "仅允许", "只有", "全部包括", "全部包含", "全部为", "全部是", "全部如下", "consist of", "consists of", "comprise", "only include", "only contain"],
    "introduces": ["如下", "以下为", "以下是", "依次为", "分别为", "following"],
    "opens": ["例如", "诸如", "之一", "部分", "主要", "至少", "等等", "...", "……"],
    "elsewhere": ["另见", "详见", "参见", "请见", "请查看"],
}
#: Signs of two words, the second next to the first but for white space.
PAIRS = {
    "elsewhere": [
        (["查看", "查阅"], ["附件", "附录", "文档", "详情", "具体", "下文", "表"]),
        (["具体", "详情", "完整", "完整内容", "完整条款", "完整规则"], ["见", "查看", "参见", "请见", "请查看", "请参见"]),
        (["附件", "附录", "下文", "制度", "制度正文", "文档", "表"], ["中", "内", "详见"]),
    ],
}
#: Everything of a kind, and how it is told; numbers of members; verbs of parts.
ALL_OF, ALL_ARE = ["所有", "所有内容", "所有项目", "所有条目", "所有成员", "所有元素", "所有项", "所有条"], ["如下", "为", "是"]
SEEN_IN = ["附件", "附录", "下文", "制度", "文档", "表"]
TOTALS, MEMBERS, NUMERALS = ["共", "总计", "合计"], ["项", "条", "个", "种", "类", "步", "阶段", "部分", "方面"], "一二三四五六七八九十百两"
PARTS_WITHIN, MADE_OF = 200, ["构成", "组成"]
INCLUDING, ONLY = ["包括", "包含"], "仅"
#: Headings of overviews, tags of tables, and signs of a specific clause.
OVERVIEW_TITLES = ["总则", "适用范围", "适用对象", "目的", "背景", "术语定义", "术语和定义", "术语与定义", "定义"]
TABLE_TAGS = ["table", "thead", "tbody", "tr", "td", "th"]
SPECIFIC_WORDS = ["不超过", "不得", "必须", "应当", "标准", "上限", "下限", "步骤", "流程", "参数", "配置项"]
SPECIFIC_UNITS = ["元", "%", "天", "小时", "分钟", "个", "次", "公里", "gb", "mb"]


def holds_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def joined(firsts: list[str], seconds: list[str]) -> list[str]:
    return [a + b for a in firsts for b in seconds]


def with_numbers_as(mark: str, text: Column, numerals: str = "") -> Column:
    """Each number, with the white space around it, as the mark: `共 12 项` is `共#项`."""
    return F.regexp_replace(text, rf"\s*(?:\d+|[{numerals}]+)\s*" if numerals else r"\s*\d+\s*", mark)


def any_of(values: list[str]) -> str:
    """A pattern for one of these texts, the longest first."""
    return "(?:" + "|".join(f"\\Q{v}\\E" for v in sorted(values, key=len, reverse=True)) + ")"


def normalize_markdown(c: Column) -> Column:
    """Line ends, breaks, code marks, lists run into one line, and at most two blank lines, all outside of fences."""
    t = F.regexp_replace(c, r"\r\n?", "\n")

    def outside(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
        x = F.regexp_replace(x, r"(?is)<code>(.*?)</code>", "`$1`")
        x = F.when(F.regexp_count(x, F.lit(r" \* ")) >= 2, F.regexp_replace(x, r"[ \t]+\* ", "\n* ")).otherwise(x)
        return F.regexp_replace(x, r"\n{4,}", "\n\n\n")

    parts = F.split(t, "```")
    made = F.transform(parts, lambda x, i: F.when(i % 2 == 0, outside(x)).otherwise(F.concat(F.lit("```"), x, F.when(x.endswith("\n"), "").otherwise("\n"), F.lit("```"))))
    joined = F.array_join(made, "\u0000")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "(?<=[^\n\u0000])\u0000", "\n"), "\u0000(?=[^\n\u0000])(?!```)", "\n"), "\u0000", "")


def compatibility_statements(text: Column, products: list[str]) -> Column:
    """Versions of a product (under any of its names) that a text says it supports, that it says it does not, and the names used.

    The text is cut at every name with a version; what a mention claims is told by
    the end of the piece before it and by the start of the piece behind it.
    """
    t = F.regexp_replace(text, r"[ \t]+", "")
    name_of = rf"(?i:{any_of([p.replace(' ', '') for p in products])})"
    named = rf"{name_of}(?:版本|[vV])?\d{{1,4}}(?:\.\d{{1,4}}){{0,3}}(?![\d.]*\d)"
    pieces = F.split(t, named, -1)
    around = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda before, behind: F.struct(before.alias("before"), behind.alias("behind")))
    said, denied = any_of(SUPPORT_WORDS), any_of(DENIALS)
    claim = lambda piece, pattern: F.when(piece.rlike(pattern), F.regexp_extract(piece, pattern, 1) == "")

    def mention(x: Column, at: Column) -> Column:
        before, behind = claim(at["before"], f"({denied}?){said}$"), claim(at["behind"], f"^[，,：:;；的]*({denied}?){said}")
        either = lambda wanted: F.coalesce(before == wanted, F.lit(False)) | F.coalesce(behind == wanted, F.lit(False))
        return F.struct(x.alias("text"), either(True).alias("yes"), either(False).alias("no"))

    mentions = F.zip_with(F.regexp_extract_all(t, F.lit(named), F.lit(0)), F.slice(around, F.lit(1), F.size(around) - 1), mention)
    version = lambda m: canonical_version(F.regexp_extract(m["text"], r"([\d.]+)$", 1))
    name = lambda m: F.lower(F.regexp_extract(m["text"], name_of, 0))
    pick = lambda part, keep: F.array_distinct(F.transform(F.filter(mentions, keep), part))
    return F.struct(pick(version, lambda m: m["yes"]).alias("compatible"), pick(version, lambda m: m["no"]).alias("unsupported"), pick(name, lambda m: m["yes"] | m["no"]).alias("products"))


def collection_flags(sentence: Column) -> Column:
    """Whether a sentence says that its list is whole: a sign of it, and none to the contrary."""
    t = F.lower(F.regexp_replace(sentence, r"\s+", " "))
    close = F.regexp_replace(t, " ", "")  # for signs whose words may stand apart
    sign = lambda role: holds_any(t, SIGNS[role])
    counted = holds_any(with_numbers_as("#", t, NUMERALS), joined(TOTALS, ["#" + m for m in MEMBERS]))
    made_of = sentence.rlike(f"由.{{1,{PARTS_WITHIN}}}{any_of(MADE_OF)}")
    divided = sentence.rlike(f"分为.{{1,{PARTS_WITHIN}}}(?:[、,，;；。]|$)")
    closes = sign("closes") | holds_any(t, joined(ALL_OF, ALL_ARE)) | counted | made_of | divided
    free = t
    for word in INCLUDING:
        free = F.replace(free, F.lit(ONLY + word), F.lit(" "))
    opens = sign("opens") | holds_any(free, INCLUDING) | F.array_contains(F.split(t, r"\W+"), "etc")
    elsewhere = sign("elsewhere") | holds_any(t, joined(["见"], SEEN_IN)) | holds_any(close, [w for pair in PAIRS["elsewhere"] for w in joined(*pair)])
    return F.struct(closes.alias("closes"), sign("introduces").alias("introduces"), opens.alias("opens"), elsewhere.alias("elsewhere"), ((closes | sign("introduces")) & ~opens & ~elsewhere).alias("closed"))


def section_kind(content: Column, declared: Column) -> Column:
    """The declared kind, else table, overview, specific or other by the look of it."""
    lines = F.split(content, "\n")
    rows = F.size(F.filter(F.slice(lines, 1, 20), lambda x: F.size(F.split(x, r"\|")) >= 3))
    full = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != "")
    ruled = F.exists(F.sequence(F.lit(1), F.greatest(F.size(full) - 1, F.lit(1))), lambda i: F.coalesce(F.get(full, i - 1).rlike(r"^\|.+\|$") & F.get(full, i).rlike(r"^\|:?-{3}"), F.lit(False)))
    marked = F.arrays_overlap(F.regexp_extract_all(F.lower(content), F.lit(r"<(\w+)"), F.lit(1)), F.array(*[F.lit(x) for x in TABLE_TAGS]))
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.substring(content, 1, 300)), r"^\s*#{1,6}\s*", ""), rf"^第?[{NUMERALS[:-1]}0-9]+[章节、.．]\s*", "")
    overview = F.split(bare, r"[\s：:。]", 2)[0].isin(OVERVIEW_TITLES)
    low = F.lower(content)
    clause = F.contains(F.regexp_replace(low, rf"[{NUMERALS[:-1]}0-9]+", "#"), F.lit("第#条")) | content.rlike(r"\d\.\d+\s")
    specific = clause | holds_any(low, SPECIFIC_WORDS) | holds_any(with_numbers_as("#", low), ["#" + u for u in SPECIFIC_UNITS])
    seen = F.when(ruled | marked | (rows >= 2), "table").when(overview, "overview").when(specific, "specific").otherwise("other")
    named = F.lower(F.trim(declared))
    return F.when(named.isin("table", "specific", "overview", "other"), named).otherwise(seen)
