"""Objects and quotations within longer texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that a quotation's ends need to be looked for, and the longest that it is restored to.
LEAST_END, LONGEST = 12, 5000
ELLIPSES = ("...", "…")

#: What matters to brackets: an escaped character, a quotation mark, a brace.
_SIGNS = r'(?s)\\.|["{}]'


def _let(value: Column, then) -> Column:
    """``then`` of a value that is made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def balanced_object(text: Column) -> Column:
    """From the first opening brace to the one that closes it; braces in strings do not count, and after a backslash nothing does.

    Null if there is no brace, or none that closes the first. What a broken object holds is not taken for it.
    """
    def scan(s: Column) -> Column:
        steps = F.zip_with(F.split(s, _SIGNS, -1), F.regexp_extract_all(s, F.lit(_SIGNS), F.lit(0)), lambda piece, sign: F.struct(piece.alias("piece"), sign.alias("sign")))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(None).cast("int").alias("end"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.length(x["piece"]) + F.length(F.coalesce(x["sign"], F.lit("")))
            turn = F.when(acc["quoted"], 0).when(x["sign"] == "{", 1).when(x["sign"] == "}", -1).otherwise(0)
            closes = acc["end"].isNull() & (turn == -1) & (acc["depth"] == 1)
            return F.struct(at.alias("at"), (acc["depth"] + turn).alias("depth"), (acc["quoted"] != F.coalesce(x["sign"] == '"', F.lit(False))).alias("quoted"), F.when(closes, at).otherwise(acc["end"]).alias("end"))

        return F.substring(s, F.lit(1), F.aggregate(steps, start, step)["end"])

    first = F.instr(text, "{")
    return F.when(first > 0, _let(F.substring(text, first, F.length(text)), scan))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part that is not empty stands in a text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def quotation(text: Column, quote: Column) -> Column:
    """struct(state, start, length) of a quotation in a text, start from 0.

    ``exact``: it stands there (the first place counts). ``restored``: it has one ellipsis, and what stands before and after it, at
    least LEAST_END characters each, stands in the text once, in that order, at most LONGEST characters in all; then place and
    length are those of what was left out, too. ``several``: an end stands there more than once. ``none``: all else.
    """
    marks = sum((occurrences(quote, F.lit(e)) for e in ELLIPSES), F.lit(0))
    mark = F.when(F.contains(quote, F.lit(ELLIPSES[0])), ELLIPSES[0]).otherwise(ELLIPSES[1])
    place = lambda part: F.call_function("locate", part, text) - 1

    def judge(x: Column) -> Column:
        n, m = occurrences(text, x["head"]), occurrences(text, x["tail"])
        start, end = place(x["head"]), place(x["tail"]) + F.length(x["tail"])
        follows = place(x["tail"]) >= start + F.length(x["head"])
        state = F.when((n == 0) | (m == 0), "none").when((n > 1) | (m > 1), "several").when(follows & (end - start <= LONGEST), "restored").otherwise("none")
        return F.struct(state.alias("state"), F.when(state == "restored", start).alias("start"), F.when(state == "restored", end - start).alias("length"))

    nothing = F.struct(F.lit("none").alias("state"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"))
    exact = F.struct(F.lit("exact").alias("state"), place(quote).alias("start"), F.length(quote).alias("length"))
    ends = F.struct(F.trim(F.split_part(quote, mark, F.lit(1))).alias("head"), F.trim(F.split_part(quote, mark, F.lit(-1))).alias("tail"))
    bounded = _let(ends, lambda x: F.when((F.length(x["head"]) < LEAST_END) | (F.length(x["tail"]) < LEAST_END), nothing).otherwise(judge(x)))
    return F.when(text.isNull() | quote.isNull() | (quote == ""), nothing).when(F.contains(text, quote), exact).when(marks == 1, bounded).otherwise(nothing)


# Signs that open and close formulas, and what closes which.
MATH_SIGN = r"(?<!\\)(?:\$\$|\$|\\[\[\]()]|\\(?:begin|end)\{[^{}]+\})"
CLOSERS = {"$": "$", "$$": "$$", r"\[": r"\]", r"\(": r"\)"}
_SPAN = "array<struct<start:int,end:int,complete:boolean>>"


def math_spans(text: Column) -> Column:
    """array of (start, end, complete): the formulas of a text from the outside, start from 0, end exclusive.

    Environments nest; within a formula only environments open anew. What is never closed is a span to the text's end that
    is not complete. Null has none. One walk over the signs, with those that are still to come as a stack.
    """

    def scan(s: Column) -> Column:
        steps = F.zip_with(F.split(s, MATH_SIGN, -1), F.regexp_extract_all(s, F.lit(MATH_SIGN), F.lit(0)), lambda piece, sign: F.named_struct(F.lit("gap"), F.length(piece), F.lit("sign"), F.coalesce(sign, F.lit(""))))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("begin"), F.array().cast("array<string>").alias("open"), F.array().cast(_SPAN).alias("found"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            end = begin + F.length(x["sign"])
            depth = F.size(acc["open"])
            closes = (depth > 0) & (x["sign"] == F.get(acc["open"], depth - 1))
            plain = F.create_map(*[F.lit(v) for pair in CLOSERS.items() for v in pair])
            closer = F.when(F.startswith(x["sign"], F.lit(r"\begin{")), F.concat(F.lit(r"\end"), F.substring(x["sign"], F.lit(7), F.length(x["sign"])))).when(depth == 0, F.try_element_at(plain, x["sign"]))
            opens = ~closes & closer.isNotNull()
            stack = F.when(closes, F.slice(acc["open"], F.lit(1), F.greatest(depth - 1, F.lit(0)))).when(opens, F.array_append(acc["open"], closer)).otherwise(acc["open"])
            span = F.named_struct(F.lit("start"), acc["begin"], F.lit("end"), end, F.lit("complete"), F.lit(True))
            found = F.when(closes & (depth == 1), F.array_append(acc["found"], span)).otherwise(acc["found"])
            return F.named_struct(F.lit("at"), end, F.lit("begin"), F.when(opens & (depth == 0), begin).otherwise(acc["begin"]), F.lit("open"), stack, F.lit("found"), found)

        tail = lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["found"], F.named_struct(F.lit("start"), acc["begin"], F.lit("end"), F.length(s), F.lit("complete"), F.lit(False)))).otherwise(acc["found"])
        return F.aggregate(steps, start, step, tail)

    signed = F.contains(text, F.lit("$")) | F.contains(text, F.lit("\\"))  # no sign is without one of these
    return F.when(signed, _let(text, scan)).otherwise(F.array().cast(_SPAN))


def math_contents(text: Column, spans: Column) -> Column:
    """What the complete formulas hold, without the signs around them; environments keep theirs."""

    def inner(s: Column) -> Column:
        whole = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        width = F.when(F.regexp_like(whole, F.lit(r"^(?:\$\$|\\[\[(])")), 2).when(F.startswith(whole, F.lit("$")), 1).otherwise(0)
        return strip(F.substring(whole, width + 1, F.length(whole) - 2 * width))

    return F.transform(F.filter(spans, lambda s: s["complete"]), inner)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
