"""Text functions as Spark columns: tokenizers, normal forms, anchors and numbers.

Built-in functions throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\x{4E00}-\\x{9FFF}"
#: Every character with the Unicode property White_Space.
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# The shapes of tokens, of quoted terms and of what separates and surrounds their parts.
INDEX_TOKEN = f"[A-Za-z]+[0-9]+|[0-9]+(?:\\.[0-9]+)?%?|[A-Za-z]+|[{CJK}]"
#: INDEX_TOKEN as Python spells it.
INDEX_TOKEN_PY = "[A-Za-z]+[0-9]+|[0-9]+(?:\\.[0-9]+)?%?|[A-Za-z]+|[一-鿿]"
CARD_TOKEN = f"\\d+(?:\\.\\d+)?%?|[A-Za-z]+|[{CJK}]+"
QUOTED = "[‘’“\"《]([^’”\"》]{2,24})[’”\"》]"
QUOTED_ANCHOR, ANCHOR_SEPARATOR, ANCHOR_EDGE = "[“\"]([^”\"]{2,80})[”\"]", "[、,，/]|或|以及|等", "^[\\s‘’'（(]+|[\\s‘’'）)]+$"

# Groups of query words that stand for each other.
SYNONYMS = (
    ("一季度", "第一季度", "q1", "1-3月", "1至3月"),
    ("二季度", "第二季度", "q2", "4-6月", "4至6月"),
    ("三季度", "第三季度", "q3", "7-9月", "7至9月"),
    ("四季度", "第四季度", "q4", "10-12月", "10至12月"),
    ("增长", "增加", "上升", "提高"),
    ("下降", "减少", "下滑", "回落", "降低"),
    ("现金分红", "分红", "股利", "利润分配", "派息"),
)

# Words too general to count as a shared phrase or an anchor.
GENERAL_WORDS = ("保险", "责任", "条款", "产品", "公司", "明确", "列明", "规定", "约定", "包含", "关于", "说法", "正确", "下列", "选项", "处理")

# Fixed value: a number with its unit.
NUMBER_UNIT = (
    "\\d{4}\\s*年(?:\\s*\\d{1,2}\\s*月(?:\\s*\\d{1,2}\\s*日)?)?"
    "|-?\\d[\\d,]*(?:\\.\\d+)?\\s*(?:%|个工作日|工作日|周岁|岁|个月|月|日|天|小时|分钟|元|万元|亿元|倍|份|次|项|年)"
    "|[零〇一二三四五六七八九十百千万两]+(?:个)?(?:工作日|周岁|岁|年|月|日|天|次|项|份)"
)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, also where functions within ``f`` read it for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def pairs(items: Column, join: bool = True) -> Column:
    """Adjacent pairs of an array, joined."""
    return F.zip_with(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: F.concat(a, b))


def _is_cjk(token: Column) -> Column:
    return token.rlike(f"^[{CJK}]")


def raw_tokens(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), "％，", "%,")
    return all_matches(plain, INDEX_TOKEN)


def tokens(text: Column) -> Column:
    """Index tokens: words and numbers in lower case, single CJK characters, and pairs of CJK characters that follow each
    other as tokens, whatever stood between them in the text.

    The pairs come last; order among tokens has no meaning to an index.
    """
    raw = raw_tokens(text)
    both = F.zip_with(
        F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0))),
        F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0))),
        lambda a, b: F.when(_is_cjk(a) & _is_cjk(b), F.concat(a, b)),
    )
    # texts without CJK characters, the usual case in Latin corpora, build no pairs
    cjk = F.coalesce(text, F.lit("")).rlike(f"[{CJK}]")
    lower = F.transform(raw, F.lower)
    return F.when(cjk, F.concat(lower, F.filter(both, lambda x: x.isNotNull()))).otherwise(lower)


def _tokens_of(word: str) -> list[str]:
    """tokens() of a fixed word, so that plans hold its tokens and not the expressions that find them."""
    raw = re.findall(INDEX_TOKEN_PY, word)
    both = [a + b for a, b in zip(raw, raw[1:]) if a >= "一" and b >= "一"]
    return [t.lower() for t in raw] + both


def query_tokens(text: Column, synonyms=SYNONYMS) -> Column:
    """Index tokens of a query, then the unseen tokens of its years' last two digits and of its words' synonyms, once each."""
    source = F.coalesce(text, F.lit(""))
    folded = F.translate(F.lower(source), "—–", "--")
    years = F.transform(all_matches(source, "(?<!\\d)20(\\d{2})(?!\\d)", 1), lambda y: y)
    more = years
    for group in synonyms:
        occurs = F.lit(False)
        for alias in group:
            occurs = occurs | F.contains(folded, F.lit(alias.lower()))
        known = [F.lit(t) for alias in group for t in _tokens_of(alias)]
        more = F.concat(more, F.when(occurs, F.array(*known)).otherwise(F.array().cast("array<string>")))
    own = tokens(source)
    return F.concat(own, F.array_except(F.array_distinct(more), own))


def card_tokens(text: Column) -> Column:
    """Tokens of clause cards: letters and digits apart, CJK runs as characters and pairs that stand together in the text."""
    plain = F.translate(F.coalesce(text, F.lit("")), "％", "%")
    found = all_matches(plain, CARD_TOKEN)

    def of(run: Column) -> Column:
        chars = F.filter(F.split(run, ""), lambda c: c != "")
        return F.when(_is_cjk(run), F.concat(chars, pairs(chars))).otherwise(F.array(F.lower(run)))

    return F.flatten(F.transform(found, of))


def numbers_with_units(text: Column) -> Column:
    """Numbers with their units, without white space, in order, each once."""
    found = all_matches(F.translate(F.coalesce(text, F.lit("")), "％", "%"), NUMBER_UNIT)
    # every number has a digit or a CJK numeral
    may = F.coalesce(text, F.lit("")).rlike(f"[0-9〇{CJK}]")
    return F.when(may, F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "\\s+", "")))).otherwise(F.array().cast("array<string>"))


def quoted_keywords(text: Column, most: int = 8) -> Column:
    """Terms of 2 to 24 characters in quotation marks, trimmed, each once, the first few."""
    trimmed = F.transform(all_matches(F.coalesce(text, F.lit("")), QUOTED, 1), strip)
    return F.slice(F.array_distinct(F.filter(trimmed, lambda x: x != "")), 1, most)


def anchors(text: Column) -> Column:
    """Parts of quoted terms, split at separators and trimmed of quotation marks and brackets, each once."""
    parts = F.flatten(F.transform(all_matches(F.coalesce(text, F.lit("")), QUOTED_ANCHOR, 1), lambda q: F.split(q, ANCHOR_SEPARATOR)))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, ANCHOR_EDGE, ""))
    return F.array_distinct(F.filter(bare, lambda p: (F.length(p) >= 2) & ~p.isin(*GENERAL_WORDS)))


def without_numbers(text: Column) -> Column:
    """The query with each run of digits and number signs as one blank, if that changes it and leaves 8 characters; else null."""
    bare = F.regexp_replace(text, "[0-9.,%％]+", " ")
    return F.when((bare != text) & (F.length(strip(bare)) >= 8), bare)


def shared_phrases(query: Column, text: Column, longest: int = 10) -> Column:
    """Longest phrases of 2 to ``longest`` characters of a query that occur in a text, none within another."""
    runs = all_matches(F.regexp_replace(F.coalesce(query, F.lit("")), "\\s+", ""), f"[A-Za-z0-9.%％{CJK}]+")

    def cuts(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1)))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.lit(longest)), lambda n: F.when(i + n - 1 <= F.length(run), F.substr(run, i, n)))))

    found = F.array_distinct(F.filter(F.array_distinct(F.flatten(F.transform(runs, cuts))), lambda p: p.isNotNull() & F.contains(text, p) & ~p.isin(*GENERAL_WORDS)))
    # what a phrase without its first or last character leaves is within it; general words are as short as phrases go, so leaving them out breaks no chain of these
    shorter = lambda q: F.array(F.substr(q, F.lit(2)), F.substr(q, F.lit(1), F.length(q) - 1))
    return bound(found, lambda phrases: F.array_except(phrases, F.flatten(F.transform(phrases, shorter))))


def compact(text: Column) -> Column:
    """Without white space, with one sign for percent."""
    return F.translate(F.coalesce(text, F.lit("")), "％" + WHITE_SPACE, "%")


def trim_of(text: Column, chars: str) -> Column:
    """Without leading and trailing characters of a set."""
    return F.btrim(text, F.lit(chars))


def title_compact(text: Column) -> Column:
    """A title without blanks, wide dots and leaders, trimmed of bullets and punctuation."""
    plain = F.translate(text, "\u00a0\u3000 \t\r\n．…", "")
    return trim_of(plain, "·•◆◇*-—_，,。；;：:")


def clean_page(text: Column) -> Column:
    """Text of a page: right-trimmed lines, three or more one-character lines in a row glued, blank runs collapsed.

    Digits alone on a line are no one-character lines; a blank line ends a run.
    """
    lines = F.transform(F.split(F.translate(text, "\u00a0\uf043", " ·"), "\n", -1), lambda x: F.regexp_replace(x, "(?U)\\s+$", ""))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))
    flushed = lambda a: F.concat(a["out"], F.when(F.size(a["run"]) >= 3, F.array(F.array_join(a["run"], ""))).otherwise(a["run"]))
    single = lambda x: (F.length(F.trim(x)) == 1) & ~F.trim(x).rlike("(?U)^\\d$")
    step = lambda a, x: F.when(single(x), F.struct(a["out"].alias("out"), F.concat(a["run"], F.array(F.trim(x))).alias("run"))).otherwise(
        F.struct(F.concat(flushed(a), F.array(x)).alias("out"), F.array().cast("array<string>").alias("run"))
    )
    return strip(F.regexp_replace(F.array_join(F.aggregate(lines, zero, step, flushed), "\n"), "\n{3,}", "\n\n"))


def source_family(doc_id: Column, src: Column) -> Column:
    """File stem, or the id, without an attachment suffix."""
    stem = F.regexp_replace(F.substring_index(src, "/", -1), "(?<=.)\\.[^.]*$", "")
    base = F.when(F.coalesce(src, F.lit("")) != "", stem).otherwise(doc_id)
    return F.regexp_replace(base, "(?i)[_-](?:att(?:achment)?|appendix|annex|附件)[_-]?\\d*$", "")


# Wordings that ask for several sources.
SEVERAL_SOURCES = (
    "(?:两|三|四|五|多|若干)(?:家|份|款|类|个|项)[^\\n。？?]{0,24}(?:主体|产品|文档|文件|报告|机构|合同|规定)"
    "|(?:分别|各自|逐一|比较|对比)[^\\n。？?]{0,30}(?:主体|产品|文档|文件|报告|机构|合同|规定)"
)


# Wordings by which routing takes a question to be on several documents.
SEVERAL_DOCUMENTS = "(?:两|三|四|几|多)(?:家|份|款|类|个)[^\\n。？?]{0,18}(?:公司|产品|文件|报告|机构|募集说明书|合同)|以下三份|各文件|与各文件|两家公司|四家"


def wants_several_sources(text: Column) -> Column:
    return text.rlike(SEVERAL_SOURCES)


def wants_several_documents(text: Column) -> Column:
    """What routing by company and by policy goes by."""
    return text.rlike(SEVERAL_DOCUMENTS)


# Words of titles that name no company or product, in the order in which they are taken out.
TITLE_WORDS = ("股份有限公司", "有限责任公司", "有限公司", "募集说明书", "年度报告", "研究报告", "首次覆盖报告", "公开发行", "面向专业投资者", "公司债券")
SHARED_FROM, SHARED_TO = 4, 14


def title_identity(text: Column) -> Column:
    """Letters, digits and CJK characters, without the words that name nothing."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^0-9A-Za-z{CJK}]+", "")
    for word in TITLE_WORDS:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def names_title(option: Column, title: Column) -> Column:
    """Whether the identities of an option and a title share a literal of SHARED_FROM characters; longer ones hold such a one."""
    # bound as elements of arrays, so that an inner function reads their values and doesn't make them again for each place
    both = F.transform(F.array(F.struct(title_identity(option).alias("a"), title_identity(title).alias("b"))), lambda p: F.when(F.length(p["a"]) <= F.length(p["b"]), p).otherwise(F.struct(p["b"].alias("a"), p["a"].alias("b"))))
    places = lambda p: F.sequence(F.lit(1), F.greatest(F.length(p["a"]) - (SHARED_FROM - 1), F.lit(1)))
    return F.exists(both, lambda p: (F.length(p["a"]) >= SHARED_FROM) & F.exists(places(p), lambda i: F.contains(p["b"], F.substr(p["a"], i, F.lit(SHARED_FROM)))))


# The shapes of credentials that must not be in a record.
KEY = "\\bsk-[A-Za-z0-9_-]{8,}\\b"
CREDENTIAL_HEADER = "(?i)(?:authorization|x-api-key|api[_ -]?key)[\"']?\\s*[:=]\\s*[\"']?(?!\\[REDACTED\\])[^\\s,;}'\"]+"


def leaks_credentials(text: Column) -> Column:
    """Whether a text has a key token, or a credential header whose value isn't redacted."""
    return F.coalesce(text.rlike(KEY) | text.rlike(CREDENTIAL_HEADER), F.lit(False))


def question_surface(question: Column, options: Column, separator: str = "\n") -> Column:
    """The question and its options' texts in their order, from ``options`` an array of structs with ``text``."""
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(F.coalesce(question, F.lit(""))), F.coalesce(F.transform(options, lambda o: o["text"]), none)), separator)


def ids_in_prose(text: Column) -> Column:
    """The strings of the first JSON list in a text, null if it has none that is a list."""
    return F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), "(?s)\\[.*?\\]", 0), "array<string>")


def safe_path(path: Column) -> Column:
    """Whether a path stays below the folder that it is taken from: relative, without steps ``.`` and ``..``, not empty. Doubled and last slashes say nothing."""
    steps = F.split(path, "/", -1)
    return F.coalesce((F.trim(path) != "") & ~path.rlike("^([A-Za-z]:)?[/\\\\]") & ~F.arrays_overlap(steps, F.array(F.lit("."), F.lit(".."))), F.lit(False))


def contents_like(text: Column) -> Column:
    """Whether a chunk looks like a table of contents."""
    return (F.regexp_count(text, F.lit("……")) >= 3) | (F.regexp_count(text, F.lit("\\.{3}")) >= 6) | (F.regexp_count(text, F.lit("(?m)^[图表]：")) >= 4)


def redact(text: Column) -> Column:
    """Credentials replaced: key tokens and the values of credential headers."""
    keys = F.regexp_replace(text, KEY, "[REDACTED]")
    header = "(?i)((?:authorization|x-api-key|api[_ -]?key)[\"']?\\s*[:=]\\s*[\"']?)(?:bearer\\s+)?([^\\s,;}'\"]+)"
    return F.regexp_replace(keys, header, "$1[REDACTED]")


def year_of(title: Column, head: Column, doc_id: Column) -> Column:
    """The year that a document names near its start, else in its id."""
    named = F.regexp_extract(F.concat_ws("\n", title, F.substring(head, 1, 800)), "(20\\d{2})\\s*年", 1)
    in_id = F.regexp_extract(doc_id, "_(20\\d{2})_", 1)
    return F.when(named != "", named).when(in_id != "", in_id)
