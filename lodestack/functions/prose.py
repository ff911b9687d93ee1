"""Goals, descriptions and the text around formulas, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.marks import language_code
from lodestack.functions.spans import strip

# Modes of tasks, and what in a goal speaks for which, the first that is found.
MODES = ["cmdengine", "mcp"]
TOOL_WORDS = ["mcp.", "tool ", "server "]
COMPLEX_VERBS = ["create", "add", "assign", "bind", "update", "delete", "deploy", "start", "join"]
SIMPLE_VERBS = ["show", "list", "get", "fetch", "search", "find", "convert", "ocr", "extract"]
# Phrases of those who ask for an organisation's chart.
CHART_PHRASES = ["organization structure", "organization chart", "org chart", "org tree", "organizational tree", "mermaid", "组织结构", "组织机构", "组织关系", "组织树", "机构关系", "机构结构"]
# Numbers that stand for a description, sentences that say nothing, where sentences end.
NUMBER_ONLY = r"^(?i)(?:(?:equation|eq\.?|formula|公式|式)\s*)?[（(]?\s*(?:[A-Z]?[.\-]?\d+(?:[.\-]\d+)*[A-Z]?|[IVXLCDM]+)\s*[)）]?[.:：]?$"
FILLER = r"(?i)包含\s*\d+\s*行|contains?\s+\d+\s+rows|语义(?:说明)?缺失|变量说明见原文|请?结合上下文解释|see the source document|refer to (?:the )?(?:source|context)|semantic (?:description )?(?:missing|unavailable)"
SENTENCE_END = r"(?<=[。!！;；])\s*|(?<=\.)(?!\d)\s*|\n+"
# Letters of Han, words of Latin letters, and how much of them tells a language.
HAN, LATIN_WORD = r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", r"\b[A-Za-z][A-Za-z'-]{1,}\b"
HAN_LEAST, WORDS_LEAST, LETTERS_LEAST = 4, 3, 12
CLAUSE_END, LEADING_NAME = r"[。！？!?\n]", r"^[^:：\n]{1,60}[:：]"
# A formula set off from the text, how its variables are introduced, what ends that, how long it may be.
DISPLAYED = r"(?s)\$\$(.*?)\$\$"
VARIABLES, VARIABLES_END = r"(?s)(式中[:：].*)", r"(?m)^\s*(?:#{1,6}\s+|(?:[A-Z]\.)?\d+(?:\.\d+){1,}\s+)"
VARIABLES_LENGTH = 1200
# Units, introductions and symbols that are no formula of their own.
UNITS = ["Pa", "kPa", "MPa", "GPa", "mm", "cm", "kg", "kN", "Hz", "rad", "mol"]
INTRODUCED = r"^(?i)(?:式中|其中|注[:：]|where\b)"
ATOM = r"(?:\\(?:Delta|delta)\s*)?(?:\\[A-Za-z]+|[A-Za-z\u0370-\u03ff])(?:\s*[_^]\s*(?:\{[^{}]+\}|[A-Za-z0-9]))*"
DEFINED = rf"^(?i){ATOM}\s*(?:[—–:：]+\s*|(?:为|表示|是)\s*|(?:is|denotes|represents)\s+).+"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])


def task_mode(goal: Column, requested: Column) -> Column:
    """The mode that is requested, if there is one; else what the goal's words speak for: tools before complex verbs before simple ones.

    Words count within others, too, so an address adds something.
    """
    low = F.lower(F.coalesce(goal, F.lit("")))
    return F.when(requested.isin(MODES), requested).when(_any(low, TOOL_WORDS), "mcp").when(_any(low, COMPLEX_VERBS), "cmdengine").when(_any(low, SIMPLE_VERBS), "mcp").otherwise("cmdengine")


def asks_chart(goal: Column) -> Column:
    return _any(F.lower(F.coalesce(goal, F.lit(""))), CHART_PHRASES)


def prose_language(text: Column) -> Column:
    """zh or en if there is enough of it outside of formulas and tags, else null."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)\$\$.*?\$\$|\$[^$]*\$", " "), r"(?is)</?[A-Za-z][^<>]*>", " ")
    words = F.regexp_extract_all(t, F.lit(LATIN_WORD), F.lit(0))
    letters = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    return F.when(F.regexp_count(t, F.lit(HAN)) >= HAN_LEAST, "zh").when((letters >= LETTERS_LEAST) & (F.size(words) >= WORDS_LEAST), "en")


def language_mismatch(text: Column, language: Column) -> Column:
    """Whether prose is in another language than expected; where Chinese is, one English clause behind its leading name will do."""
    expected, found = language_code(language), prose_language(text)
    clauses = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), LEADING_NAME, ""), CLAUSE_END)
    english = F.exists(clauses, lambda c: F.coalesce(prose_language(c) == "en", F.lit(False)))
    return ((expected == "zh") & english) | ((expected != "unknown") & F.coalesce(found != expected, F.lit(False)))


def is_number_only(text: Column) -> Column:
    return F.regexp_like(strip(text), F.lit(NUMBER_ONLY))


def valid_description(text: Column, name: Column) -> Column:
    """The sentences of a description that say something; empty if it is a number, its name again, or its name and a number."""
    t = strip(F.coalesce(text, F.lit("")))
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s:：。.!！]+", ""))
    called = F.coalesce(name, F.lit(""))
    at = F.instr(F.lower(t), F.lower(called))
    rest = F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(called), F.length(t)))).otherwise(t)
    repeats = (called != "") & ((bare(t) == bare(called)) | is_number_only(F.regexp_replace(rest, r"^[ :：。.]+|[ :：。.]+$", "")))
    said = F.filter(F.split(t, SENTENCE_END), lambda s: (strip(s) != "") & ~F.regexp_like(s, F.lit(FILLER)))
    return F.when((t == "") | is_number_only(t) | repeats, "").otherwise(strip(F.array_join(said, " ")))


def formula_blocks(text: Column) -> Column:
    """array of (before, formula, after): each displayed formula with the text between it and its neighbours."""
    found, pieces = F.regexp_extract_all(text, F.lit(DISPLAYED), F.lit(0)), F.split(text, DISPLAYED, -1)
    around = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("before"), found.alias("formula"), F.slice(pieces, F.lit(2), F.size(found)).alias("after"))
    return F.when(F.size(found) > 0, around)


def formula_variables(after: Column) -> Column:
    """What a text behind a formula says of its variables, up to the next heading, number or formula; empty if nothing."""
    told = F.regexp_extract(F.coalesce(after, F.lit("")), VARIABLES, 1)
    cut = F.get(F.split(F.get(F.split(told, VARIABLES_END, 2), F.lit(0)), r"\n\s*\$\$", 2), F.lit(0))
    return F.substring(strip(F.regexp_replace(cut, r"\n{2,}", "\n")), 1, VARIABLES_LENGTH)


def is_formula_body(content: Column, layout: Column) -> Column:
    """Whether what stands where a formula was seen belongs to the text: a formula in a line, a unit, an introduction, one symbol, a definition."""
    t = strip(F.regexp_replace(strip(F.coalesce(content, F.lit(""))), r"\\[()\[\]]|\$", ""))
    t = strip(F.regexp_replace(t, r"\\(?:mathrm|mathbf|mathit|text)\{([^{}]*)\}", "$1"))
    like = lambda p: F.regexp_like(t, F.lit(p))
    inline = F.coalesce(F.lower(layout) == "inline_formula", F.lit(False))
    return inline | ((t != "") & (t.isin(UNITS) | like(INTRODUCED) | like(f"^{ATOM}$") | like(DEFINED)))
