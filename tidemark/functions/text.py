"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}\p{Co}]+"


def _folding() -> tuple[str, str]:
    """Letters with one diacritic and their base letters: those whose decomposition is a letter and a mark."""
    pairs = [
        (chr(c), d[0])
        for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
        if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and unicodedata.category(d[1]) == "Mn"
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def fold(text: Column) -> Column:
    """Lower case without single diacritics; letters with several marks stay as they are."""
    low = F.lower(text)
    # Most texts have nothing to fold, and to look is cheaper.
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(low, FOLD_FROM, FOLD_TO)).otherwise(low)


def terms(text: Column) -> Column:
    """Index terms: runs of letters and numbers of the folded text (null: none)."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


#: Characters that are written without spaces between words.
CJK = "\\u4e00-\\u9fff\\u3400-\\u4dbf"


def bigrams(text: Column) -> Column:
    """Index terms with every run of CJK ideographs as its overlapping pairs (a single one as itself).

    The default segmenter of CJK text: where a word list is at hand, any function from a text column to an
    array of terms can take its place.
    """
    runs = F.flatten(F.transform(terms(text), lambda t: F.regexp_extract_all(t, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0))))
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    split = F.flatten(F.transform(runs, lambda run: F.when(run.rlike(f"^[{CJK}]{{2}}"), pairs(run)).otherwise(F.array(run))))
    return F.when(text.rlike(f"[{CJK}]"), split).otherwise(terms(text))


def strip(text: Column) -> Column:
    """Without white space at either end, as Unicode sees it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines by any Unicode line break; a break at the end starts no line."""
    broken = F.regexp_replace(text, r"\r\n|[\r\u000B\f\u001C-\u001E\u0085  ]", "\n")
    body = F.regexp_replace(broken, r"\n\z", "")
    return F.when(broken == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def cjk_share(text: Column) -> Column:
    """Share of CJK ideographs among all characters; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(f"[{CJK}]")) / n).otherwise(F.lit(0.0))


#: A text with more than this share of ideographs is segmented for the index.
CJK_SHARE = 0.2


def is_cjk(text: Column) -> Column:
    """Whether a file whose first page has this text is indexed by segmented words."""
    return F.coalesce(cjk_share(text) > CJK_SHARE, F.lit(False))


# Markdown cleaning, in the order in which it applies.

#: The patterns of the note syntax.
FRONT_MATTER = r"(?s)\A---\n(.*?\n)---\n?"
COMMENT = r"(?s)%%.*?%%"
EMBED = r"!\[\[.+?\]\]"
LINK_WITH_ALIAS = r"\[\[([^|\]]+?)\|([^\]]+?)\]\]"
LINK = r"\[\[([^|\]]+?)\]\]"
CALLOUT = r"(?m)^(>\s*)\[!([\p{L}\p{N}_]+)\]\s*(.*)"
BLOCK_ID = r"(?m)\s+\^[\p{L}\p{N}_-]+\s*$"
ANCHOR = r"\(#[\p{L}\p{N}_-]+\)"
TAG = r"(?<![\p{L}\p{N}_])#([\p{L}\p{N}_][\p{L}\p{N}_/-]*)(?![\p{L}\p{N}_/=-])"
HEX_COLOUR = r"^[0-9A-Fa-f]{3,8}$"


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, FRONT_MATTER, 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def clean_markdown(text: Column) -> Column:
    """The body without comments and embeds, with links as their words, callouts and block ids as text."""
    out = F.regexp_replace(text, COMMENT, "")
    out = F.regexp_replace(out, EMBED, "")
    out = F.regexp_replace(out, LINK_WITH_ALIAS, "$2")
    out = F.regexp_replace(out, LINK, "$1")
    out = F.regexp_replace(out, CALLOUT, "$1$3")
    out = F.regexp_replace(out, BLOCK_ID, "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def marked_headings(text: Column) -> Column:
    """Titles of the lines that start with a number sign, as in text read from an image."""
    return F.transform(F.filter(lines(text), lambda x: x.startswith("#")), lambda x: strip(F.regexp_replace(x, "^#+", "")))


# The part of YAML that tags are written in. Quantifiers over groups are possessive: they need no stack on long lists.
TAGS_KEY = r"""(?m)^(?:tags|'tags'|"tags")[ \t]*:(?=\s)"""
QUOTED = r""""(?:[^"\\]|\\[\s\S])*+"|'(?:[^']|'')*+'"""
FLOW_ITEM = rf"""\s*+({QUOTED}|[^,\[\]{{}}\s"'][^,\]]*+)"""
FLOW_TAGS = rf"{TAGS_KEY}[ \t]*\[((?:{FLOW_ITEM}|\s*+,|\s++)*+)\]"
BLOCK_TAGS = rf"{TAGS_KEY}[ \t]*(?:#[^\n]*)?\r?\n((?:[ \t]*+(?:-(?:[ \t][^\n]*+)?+|#[^\n]*+|\r?)\n)*+)"
BLOCK_ITEM = rf"(?m)^[ \t]*+-[ \t]*+({QUOTED}|[^\n]*+)"
ONE_TAG = rf"{TAGS_KEY}[ \t]+({QUOTED}|[^\s\[{{|>&*!#][^\n]*+)"
#: Plain words that YAML takes for yes, no, nothing, and numbers or days.
YES, NO, NOTHING = r"^(?:true|True|TRUE|yes|Yes|YES|on|On|ON)$", r"^(?:false|False|FALSE|no|No|NO|off|Off|OFF)$", r"^(?:~|null|Null|NULL)?$"
NUMBER = r"^[-+]?(?:0x[0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9_]*(?:[eE][-+][0-9]+)?)?|\.[0-9][0-9_]*|\.(?:inf|nan))$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _plain(item: Column) -> Column:
    """An item that is not quoted, without its comment."""
    return strip(F.regexp_replace(item, r"(?:^|[ \t])#[^\n]*", ""))


def _tag(item: Column) -> Column:
    """An item as text: without its quotes, yes and no as ``True`` and ``False``, nothing as ``None``."""
    inner, plain = F.substr(item, F.lit(2), F.length(item) - 2), _plain(item)
    return (
        F.when(item.startswith('"'), F.regexp_replace(inner, r'\\([\s\S])', "$1"))
        .when(item.startswith("'"), F.replace(inner, F.lit("''"), F.lit("'")))
        .when(plain.rlike(YES), "True").when(plain.rlike(NO), "False").when(plain.rlike(NOTHING), "None").otherwise(plain)
    )


def front_matter_tags(text: Column) -> Column:
    """Tags of the front matter: ``tags: [a, "b, c"]`` over one line or several, a list of ``- a`` lines, or ``tags: a``.

    Items may be quoted and have comments behind them; a single tag that is a number, a day, yes, no or nothing is
    none. Lists in lists, maps, block scalars and anchors are not read, nor is the rest of the front matter checked.
    """
    fm = front_matter(text)
    block, one = F.regexp_extract(fm, BLOCK_TAGS, 1), F.regexp_extract(fm, ONE_TAG, 1)
    listed = F.transform(F.regexp_extract_all(block, F.lit(BLOCK_ITEM), F.lit(1)), _tag)
    flowed = F.transform(F.regexp_extract_all(F.regexp_extract(fm, FLOW_TAGS, 1), F.lit(FLOW_ITEM), F.lit(1)), _tag)
    typed = F.array(*(F.lit(kind) for kind in (YES, NO, NOTHING, NUMBER)))
    word = one.startswith('"') | one.startswith("'") | ~F.exists(typed, lambda kind: F.regexp(_plain(one), kind))
    none = F.array().cast("array<string>")
    return F.when(fm.rlike(FLOW_TAGS), flowed).when(block != "", listed).when((one != "") & word, F.array(_tag(one))).otherwise(none)


def inline_tags(text: Column) -> Column:
    """#tags outside of headings, without anchors, URL fragments and colour codes, in order."""
    kept = F.filter(lines(F.regexp_replace(text, ANCHOR, "")), lambda x: ~x.rlike(r"^#{1,6}(?U)\s"))
    found = F.flatten(F.transform(kept, lambda x: F.regexp_extract_all(x, F.lit(TAG), F.lit(1))))
    return F.array_distinct(F.filter(found, lambda t: ~t.rlike(HEX_COLOUR)))


def merged_tags(text: Column) -> Column:
    """Front-matter tags, repeats kept, then inline tags that are new."""
    fm = front_matter_tags(text)
    return F.concat(fm, F.array_except(inline_tags(body(text)), fm))


# Questions.

#: Signs that a question asks for exact words, and words that ask for tables.
SIGNALS = (r'"[^"]+"', r"(?U)\b\d{4}[-/]\d{1,2}", r"(?U)\.\w{2,4}\b", r"[A-Z]{2,}\d+")
TABLE_WORDS = ("表格", "数据", "统计", "总计", "合计", "金额", "数量", "比例", "table", "data", "total", "sum", "amount", "count", "ratio", "percent")


def signal_count(question: Column) -> Column:
    out = F.lit(0)
    for pattern in SIGNALS:
        out = out + question.rlike(pattern).cast("int")
    return out


def keyword_weight(question: Column) -> Column:
    n = signal_count(question)
    return F.when(n >= 2, 2.0).when((F.length(question) > 20) & (n == 0), 0.5).otherwise(1.0)


def vector_weight(question: Column) -> Column:
    n = signal_count(question)
    return F.when(n >= 2, 0.5).when((F.length(question) > 20) & (n == 0), 2.0).otherwise(1.0)


def asks_for_table(question: Column) -> Column:
    return F.lower(question).rlike("|".join(TABLE_WORDS))


# Names and small encodings.

#: Media types by suffix.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".md": "text/markdown; charset=utf-8",
    ".txt": "text/plain; charset=utf-8",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last part of a path, with its dot; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def media_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for name, value in MEDIA_TYPES.items():
        out = F.when(suffix(path) == name, F.lit(value)).otherwise(out)
    return out


def excluded(path: Column) -> Column:
    """Whether a part of the path is one of the folders that are never read."""
    return path.rlike(r"(^|/)(\.obsidian|\.trash|\.git)(/|$)")


def safe_name(name: Column) -> Column:
    """A folder name for a model: everything but letters, digits, dot, dash and underscore becomes a dash."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def string_list(json: Column) -> Column:
    """A JSON list of strings; an empty list where the JSON is bad or null."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
