"""Column functions on text; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fence names of languages, and the verbs of function names.
FENCES = {
    "Rust": "rust", "TypeScript": "typescript", "JavaScript": "javascript", "Python": "python", "Go": "go", "Java": "java", "C": "c", "C++": "cpp",
    "C#": "csharp", "Ruby": "ruby", "Swift": "swift", "Kotlin": "kotlin", "Shell": "bash", "Lua": "lua",
}
VERBS = {
    "retrieves": "get fetch load read find query retrieve",
    "updates": "set update put store save write",
    "creates a new": "create new build make init initialize",
    "removes": "delete remove drop clear destroy",
    "checks whether": "check is has can should validate verify",
    "parses": "parse decode deserialize",
    "formats": "format render display serialize encode",
    "handles": "handle process run execute perform",
    "converts": "convert transform map to from into",
}


def template(text: str, *values: Column | str) -> Column:
    """``text`` with each {} replaced by the next value; strings name columns."""
    parts = text.split("{}")
    out: list[Column] = []
    for i, part in enumerate(parts):
        if part:
            out.append(F.lit(part))
        if i < len(parts) - 1:
            out.append((F.col(values[i]) if isinstance(values[i], str) else values[i]).cast("string"))
    return F.concat(*out)


def line_count(text: Column) -> Column:
    """Lines ended by \\n or by the end of the text; an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(ends + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def lines(text: Column) -> Column:
    """The lines as an array, without their ends."""
    parts = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def quarter_bytes(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down: the quick token estimate."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def estimated_tokens(text: Column) -> Column:
    """Mean of bytes / 3.5 and words * 1.3, in integer steps."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"\P{IsWhite_Space}+"), F.lit(0)))
    return F.floor((F.floor(F.octet_length(text) * 10 / 35) + F.floor(words * 13 / 10)) / 2).cast("long")


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{IsWhite_Space}+", "") == ""


def alphanumeric_share(text: Column) -> Column:
    kept = F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]", "")
    return F.length(kept) / F.greatest(F.length(text), F.lit(1))


def average_line_bytes(text: Column) -> Column:
    """Bytes by lines, in whole bytes; null without lines."""
    return F.floor(F.octet_length(text) / F.nullif(line_count(text), F.lit(0))).cast("long")


def fenced_line_count(text: Column) -> Column:
    """Lines in the first block that is fenced by lines starting with ```; up to
    the end if it isn't closed, 0 without a fence."""
    body = F.regexp_extract(F.concat(F.lit("\n"), text), r"(?s)\n```[^\n]*\n?(.*)", 1)
    body = F.split(F.concat(F.lit("\n"), body), r"\n```", 2)[0]
    return F.when(F.concat(F.lit("\n"), text).contains("\n```"), line_count(F.regexp_replace(F.substr(body, F.lit(2)), r"\n\z", ""))).otherwise(0)


def code_block(text: Column) -> Column:
    """What stands in the first fence, wherever it is; null without one. A fence that
    ends the text closes it, so that fences inside the code stay."""
    outer, inner = r"(?s)```[^\n]*\n(.*)```\s*\z", r"(?s)```[^\n]*\n(.*?)```"
    return F.when(text.rlike(outer), F.regexp_extract(text, outer, 1)).when(text.rlike(inner), F.regexp_extract(text, inner, 1))


def fence_name(language: Column) -> Column:
    pairs = [F.lit(x) for kv in FENCES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), language), F.lit(""))


def name_words(name: Column) -> Column:
    """Parts of a snake_case name; other names stay whole."""
    return F.when(name.contains("_"), F.filter(F.split(name, "_"), lambda w: w != "")).otherwise(F.array(name))


def purpose_of_name(name: Column) -> Column:
    """What a function called so seems to do."""
    words = F.transform(name_words(name), F.lower)
    verb, rest = F.element_at(words, 1), F.array_join(F.slice(words, 2, 1_000_000), " ")
    families = [(verb.isin(*v.split()), F.lit(k)) for k, v in VERBS.items()]
    said = reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), reversed(families), F.concat(verb, F.lit("s")))
    return F.when(F.size(words) == 0, "performs an operation").otherwise(F.concat(said, F.lit(" "), rest))


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def last_lines(text: Column, n: int) -> Column:
    return F.when(line_count(text) <= n, text).otherwise(F.array_join(F.slice(lines(text), -n, n), "\n"))


def first_lines(text: Column, n: int) -> Column:
    return F.when(line_count(text) <= n, text).otherwise(F.array_join(F.slice(lines(text), 1, n), "\n"))


def safe_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}-]", "_"))


def yaml_escaped(text: Column) -> Column:
    for old, new in (('"', '\\"'), ("\n", " "), ("\r", ""), (":", " -")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def size_bucket(n: Column) -> Column:
    bounds = ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"))
    return reduce(lambda out, b: F.when(n < b[0], b[1]).otherwise(out), reversed(bounds), F.lit("1M<n<10M"))


def is_badge(line: Column) -> Column:
    low = F.lower(line)
    return low.contains("shields.io") | low.contains("badge") | low.contains("[![") | (low.contains("![") & low.contains("](http"))


def truncated_sentences(text: Column, sentences: int = 3, most_bytes: int = 500) -> Column:
    """Up to so many . ! ? signs; what is still longer than ``most_bytes`` bytes ends
    at its last blank within them, and "..." follows."""
    ended = F.regexp_extract(text, rf"(?s)^((?:[^.!?]*[.!?]){{{sentences}}})", 1)
    cut = F.when(ended != "", ended).otherwise(text)
    too_long = F.octet_length(F.substr(cut, F.lit(1), F.length(cut) - 1)) >= most_bytes
    data = F.encode(cut, "UTF-8")
    # a character that begins within the bytes is taken whole: up to three bytes that continue it follow
    more = F.length(F.regexp_extract(F.hex(F.substring(data, most_bytes + 1, 3)), "^((?:[89AB].)*)", 1)) / 2
    head = F.substr(data, F.lit(1), (most_bytes + more).cast("int")).cast("string")
    at_blank = F.when(head.contains(" "), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    said = F.when(too_long, F.concat(at_blank, F.lit("..."))).otherwise(cut)
    return F.regexp_replace(said, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("a")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)
