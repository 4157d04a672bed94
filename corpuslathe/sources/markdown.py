"""Paragraphs of Markdown texts: a fold over lines with a stack of containers.

The state is the stack of open containers (a quote, or a list item with the width its
content is indented by), an open fence, the paragraph under way and the finished ones.
A line first meets the open containers, then opens new ones, then is a leaf: blank,
fence, heading, rule, table, HTML, indented code or text. Text that follows a paragraph
without the containers' marks still belongs to it, lazily. All of it is one SQL
expression, evaluated once a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTE = -1
_STATE = "struct<out:array<string>,para:string,stack:array<int>,fence:string>"
RULE = r"^ {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$"
_MARK = r"(?:[-+*]|\d{1,9}[.)])(?= |$)"
_OPENERS = rf"^(?: {{0,3}}(?:>|{_MARK}) {{0,4}})+"
FENCE = r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})"
#: Leaves that end a paragraph and hold no text of one.
OTHER_LEAF = rf"{FENCE}|^ {{0,3}}#{{1,6}}(?: |$)|^ {{0,3}}[|<]|{RULE}"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _matched(line: Column, stack: Column) -> Column:
    """(rest, n): what is left of a line after the first n containers that it goes on."""

    def one(s: Column, c: Column) -> Column:
        goes_on = F.when(c == QUOTE, s["rest"].rlike("^ {0,3}>")).otherwise((F.trim(F.substr(s["rest"], F.lit(1), c)) == "") & ((F.length(s["rest"]) >= c) | (F.trim(s["rest"]) == "")))
        rest = F.when(c == QUOTE, F.regexp_replace(s["rest"], "^ {0,3}> ?", "")).otherwise(F.substr(s["rest"], c + 1))
        good = s["ok"] & goes_on
        return F.struct(F.when(good, rest).otherwise(s["rest"]).alias("rest"), (s["n"] + good.cast("int")).alias("n"), good.alias("ok"))

    return F.aggregate(stack, F.struct(line.alias("rest"), F.lit(0).alias("n"), F.lit(True).alias("ok")), one)


def _opened(rest: Column, in_para: Column) -> Column:
    """(rest, new): the containers that a line opens, and what is left of it. An empty
    item, or a numbered one that does not begin at 1, cannot interrupt a paragraph."""
    marks = F.size(F.regexp_extract_all(F.regexp_extract(rest, _OPENERS, 0), F.lit(rf">|{_MARK}"), F.lit(0)))
    turns = F.when(marks > 0, F.sequence(F.lit(1), marks)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")

    def one(s: Column, _: Column) -> Column:
        own, rule = s["rest"], s["rest"].rlike(RULE)
        quote = ~rule & own.rlike("^ {0,3}>")
        weak = in_para & (F.size(s["new"]) == 0) & own.rlike(r"^ {0,3}(?:(?:[-+*]|\d{1,9}[.)]) *$|(?!1[.)])\d{1,9}[.)])")
        item = ~rule & ~weak & own.rlike(rf"^ {{0,3}}{_MARK}")
        mark = F.length(F.regexp_extract(own, rf"^ {{0,3}}{_MARK}", 0))
        gap = F.length(F.regexp_extract(F.substr(own, mark + 1), "^( *)[^ ]", 1))
        width = mark + F.when(gap.between(1, 4), gap).otherwise(1)
        left = F.when(quote, F.regexp_replace(own, "^ {0,3}> ?", "")).when(item, F.substr(own, width + 1)).otherwise(own)
        new = F.when(quote, F.concat(s["new"], F.array(F.lit(QUOTE)))).when(item, F.concat(s["new"], F.array(width))).otherwise(s["new"])
        return F.struct(left.alias("rest"), new.alias("new"))

    return F.aggregate(turns, F.struct(rest.alias("rest"), none.alias("new")), one)


def _state(out: Column, para: Column, stack: Column, fence: Column) -> Column:
    return F.struct(out.alias("out"), para.alias("para"), stack.alias("stack"), fence.alias("fence")).cast(_STATE)


def _flushed(out: Column, para: Column) -> Column:
    return F.when(para != "", F.concat(out, F.array(para))).otherwise(out)


def _joined(para: Column, line: Column) -> Column:
    return F.concat(para, F.when(para != "", "\n").otherwise(""), F.trim(line))


def _step(s: Column, line: Column) -> Column:
    def leaf(m: Column, o: Column) -> Column:
        rest, every = o["rest"], m["n"] == F.size(s["stack"])
        blank, other = F.trim(rest) == "", rest.rlike(OTHER_LEAF)
        lazy = ~every & (F.size(o["new"]) == 0) & (s["para"] != "") & ~blank & ~other
        stack = F.when(lazy, s["stack"]).otherwise(F.concat(F.slice(s["stack"], F.lit(1), m["n"]), o["new"]))
        closed = ~lazy & (~every | (F.size(o["new"]) > 0))
        out, para = F.when(closed, _flushed(s["out"], s["para"])).otherwise(s["out"]), F.when(closed, "").otherwise(s["para"])
        none = F.lit("")
        underline = ~lazy & (para != "") & rest.rlike("^ {0,3}(?:=+|-+) *$")
        return (
            F.when(underline, _state(out, none, stack, none))  # the paragraph was a heading
            .when(blank | other, _state(_flushed(out, para), none, stack, F.regexp_extract(rest, FENCE, 1)))
            .when((para == "") & rest.rlike("^ {4}"), _state(out, none, stack, none))
            .otherwise(_state(out, _joined(para, rest), stack, none))
        )

    def after(m: Column) -> Column:
        inside = (s["fence"] != "") & (m["n"] == F.size(s["stack"]))
        ends = F.startswith(F.regexp_extract(m["rest"], "^ {0,3}(`{3,}|~{3,}) *$", 1), s["fence"])
        fenced = _state(s["out"], s["para"], s["stack"], F.when(ends, "").otherwise(s["fence"]))
        open_para = (s["para"] != "") & (m["n"] == F.size(s["stack"]))
        return F.when(inside, fenced).otherwise(let(_opened(m["rest"], open_para), lambda o: leaf(m, o)))

    # most lines begin with a letter outside of everything: they go on with a paragraph
    plain = (F.size(s["stack"]) == 0) & (s["fence"] == "") & line.rlike(r"^\p{L}")
    return F.when(plain, _state(s["out"], _joined(s["para"], line), s["stack"], s["fence"])).otherwise(let(_matched(line, s["stack"]), after))


def paragraphs(text: Column) -> Column:
    """Array of a text's paragraphs, with \\n for the line ends in them; null for null.
    Code, headings of both kinds, rules, tables and raw HTML are left out; marks of quotes
    and lists are dropped, however they are nested. Tabs count as four blanks."""
    lines = F.split(F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\t"), F.lit("    ")), "\n")
    empty = F.array().cast("array<string>")
    start = _state(empty, F.lit(""), F.array().cast("array<int>"), F.lit(""))
    return F.aggregate(lines, start, _step, lambda s: _flushed(s["out"], s["para"]))
