"""Marks, markup and noise in pages that a machine has read, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of languages, and what stands in a cell that nobody could read.
CHINESE = ["zh", "zh-cn", "zh_hans", "chinese"]
ENGLISH = ["en", "en-us", "english"]
UNREADABLE = ["n/a", "na", "n.a.", "?", "？", "无法识别", "看不清", "unreadable"]
# Alignment letters that stand for no column, signs that no column's name has, what numbers alone look like, a name's length.
ALIGNMENTS = ["c", "l", "r"]
NO_NAME_SIGNS = ["\\", "{", "}"]
NUMBERS_ONLY = r"^[\d\s\.\-~≤≥%/]+$"
NAME_LENGTH = (2, 24)
DIGIT_SHARE = 3
# Spellings in formulas that make no difference, with what they become.
SPELLINGS = [("\\,", ""), ("\\ ", ""), ("\\mathrm{~h}", "\\mathrm{h}")]
# Signs of long lines, and shares of signs.
SIGNS = "．·~`'\"-+=|!@#$%^&*()[]{}<>?/\\,.;: 　\t\n\r"
SHORT, MOST_SIGNS_SHORT, MOST_SIGNS = 5, 0.5, 0.6
# Lines at the head and foot of pages, terms of figures that are noise, parts of lines that are, and what formulas leave behind.
HEADER_LINES = [
    r"^[A-Z]{1,6}\s*/?\s*[A-Z]?\s*\d+(?:\.\d+)?\s*[—-]\s*\d{4}$",
    r"^(?:[A-Z]{1,6}\s*/?\s*[A-Z]?\s*\d+(?:\.\d+)?|TSG\s*\d+)\s*[—-]\s*\d{4}\b",
    r"^\d{1,4}$",
    r"^[—-]\s*\d{1,4}\s*[—-]$",
]
FIGURE_MARK = "[figure:"
FIGURE_NOISE = ["watermark", "overlay", "logo", "seal", "stamp", "背景水印", "水印", "table with", "table of", "tabular data"]
TEXT_NOISE = ["http://", "https://", "www.", "aqsiq.gov.cn", "国家质监监督检验检疫总局"]
FORMULA_NOISE = ["T", "t", "p", "σ", "η", "=", "Tσ", "tσ", "pσ", "σ／σ"]

# What commands on members are called, and words for forms.
MEMBER_PARTS = ["member", "role", "org"]
MEMBERSHIP, MEMBER_TOOLS = "membership", "MCP.membership."
FORM_WORDS = ["form", "表单"]


def needs_members(command: Column, tags: Column, source: Column) -> Column:
    """Whether a command works on members, by its name, its tags or its source; nulls do not."""
    name = F.coalesce(command, F.lit(""))
    part = F.exists(F.array(*[F.lit(w) for w in MEMBER_PARTS]), lambda w: F.contains(F.lower(name), w))
    tagged = F.coalesce(F.array_contains(F.transform(tags, lambda x: F.lower(x)), MEMBERSHIP), F.lit(False))
    return F.startswith(name, F.lit(MEMBER_TOOLS)) | part | tagged | (F.lower(F.coalesce(source, F.lit(""))) == MEMBERSHIP)


def asks_form(prompt: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in FORM_WORDS]), lambda w: F.contains(F.lower(F.coalesce(prompt, F.lit(""))), w))


def language_code(c: Column) -> Column:
    """zh, en, or unknown for all else and null."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(CHINESE), "zh").when(t.isin(ENGLISH), "en").otherwise("unknown")


def is_unreadable(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(UNREADABLE)


def first_text(*columns: Column) -> Column:
    """The first that is not blank, trimmed; empty if there is none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def formula_compact(c: Column) -> Column:
    """A formula or text without white space, its SPELLINGS made one."""
    return F.regexp_replace(reduce(lambda t, pair: F.replace(t, *map(F.lit, pair)), SPELLINGS, c), r"\s+", "")


def html_table_open(c: Column) -> Column:
    """Whether the first table of an HTML text is never closed."""
    return F.regexp_like(c, F.lit(r"(?i)<table\b")) & ~F.regexp_like(c, F.lit(r"(?is)<table\b.*</table\s*>"))


def plain_markdown(c: Column) -> Column:
    """Markdown without the marks of bold type and formulas; three and more line breaks are two."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\*\*(.+?)\*\*", "$1"), r"\$(.+?)\$", "$1"), r"\n{3,}", "\n\n"))


def is_garbage(c: Column) -> Column:
    """Whether a line is mostly signs, and nothing in it speaks for text.

    In a line under SHORT characters all but letters and digits are signs, and a Han pair speaks for it; in a longer one SIGNS are, and a
    Han character or a lower-case word of four letters does. Empty lines are not.
    """
    short = F.length(c) < SHORT
    rest = F.when(short, F.regexp_replace(c, r"[^\p{L}\p{N}]", "")).otherwise(F.translate(c, SIGNS, ""))
    speaks = F.when(short, F.regexp_like(c, F.lit(r"[\x{4e00}-\x{9fff}]{2}"))).otherwise(F.regexp_like(c, F.lit(r"[\x{4e00}-\x{9fff}]|[a-z]{4}")))
    return ~speaks & (F.length(c) - F.length(rest) > F.length(c) * F.when(short, MOST_SIGNS_SHORT).otherwise(MOST_SIGNS))


def header_names(cells: Column) -> Column:
    """The distinct cells of a header, trimmed, that can be the name of a column: of a name's length, without NO_NAME_SIGNS, and no numbers or alignments."""
    signs = lambda x: F.length(F.translate(x, "".join(NO_NAME_SIGNS), "")) < F.length(x)
    fits = lambda x: F.length(x).between(*NAME_LENGTH) & ~F.lower(x).isin(ALIGNMENTS) & ~signs(x) & ~F.regexp_like(x, F.lit(NUMBERS_ONLY))
    return F.array_distinct(F.filter(F.transform(cells, lambda x: F.trim(F.coalesce(x, F.lit("")))), fits))


def is_header(cells: Column) -> Column:
    """Whether few enough of the cells that are not empty hold a digit: one, or a DIGIT_SHARE-th of them; a row of empty cells is no header."""
    filled = F.array_compact(F.transform(cells, lambda x: F.nullif(x, F.lit(""))))
    plain = F.size(F.filter(filled, lambda x: ~F.regexp_like(x, F.lit("[0-9]"))))
    return (F.size(filled) > 0) & (F.size(filled) - plain <= F.greatest(F.lit(1), F.floor(F.size(filled) / DIGIT_SHARE)))


def noise_kind(line: Column) -> Column:
    """What noise a line of a page is: header (page numbers, standards with their year), figure (a figure's mark with one of the FIGURE_NOISE
    terms), text (an address, a publisher), formula (one of the FORMULA_NOISE, spaces aside); null for none. The first that holds."""
    t = F.trim(F.coalesce(line, F.lit("")))
    holds = lambda words: reduce(lambda x, y: x | y, [F.contains(F.lower(t), F.lit(w)) for w in words])
    return (
        F.when(F.regexp_like(t, F.lit("|".join(f"(?:{p})" for p in HEADER_LINES))), "header")
        .when(F.contains(F.lower(t), F.lit(FIGURE_MARK)) & holds(FIGURE_NOISE), "figure")
        .when(holds(TEXT_NOISE), "text")
        .when(F.regexp_replace(t, r"\s+", "").isin(FORMULA_NOISE), "formula")
    )


def anchor_text(line: Column) -> Column:
    """What a line that names the table below it says, 120 characters at most; null for rows of tables, blank lines and prose.

    Captions begin with the word table; headings lose their marks.
    """
    t = F.trim(line)
    named = F.when(F.regexp_like(t, F.lit(r"(?i)^(表|Table)")), t).when(F.startswith(t, F.lit("#")), F.trim(F.regexp_replace(t, "^#+", "")))
    return F.when((t == "") | F.contains(t, F.lit("|")) | F.startswith(t, F.lit("[TABLE_PLACEHOLDER]")), None).otherwise(F.substring(named, 1, 120))
