"""Symbols and imports of source files.

Files are rows; ``mapInPandas`` over distinct contents turns each into its symbols
and imports, so Spark spreads the work and copies are analysed once. Python files
are read with Python's own ``ast``; the other languages by a table of declaration
patterns and the extent of the braces after them. This finds the declarations that
the engine's generators use; it is no compiler front end: declarations that start
in the middle of a line, and macros, are not seen.
"""

from __future__ import annotations

import ast
import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("Rust", "TypeScript", "JavaScript", "Python", "Go", "Java", "C", "C++")
SYMBOL = (
    "name string, kind string, start_line int, end_line int, start_col int, byte_start int, byte_end int, source_text string, doc_comment string, signature string, "
    "parameters array<struct<name:string,type_annotation:string,is_optional:boolean>>, return_type string, parent string, visibility string, body_text string, "
    "cyclomatic int, max_nesting int"
)
IMPORT = "source string, is_wildcard boolean"
BRANCHES = r"\b(?:if|elif|else|for|while|loop|match|switch|case|catch|except|try)\b|&&|\|\|"

_JS = [
    ("function", r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(?P<name>\w+)\s*(?:<[^>{]*>)?\s*(?P<params>\()"),
    ("class", r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"),
    ("interface", r"(?:export\s+)?interface\s+(?P<name>\w+)"),
    ("type", r"(?:export\s+)?type\s+(?P<name>\w+)\s*(?:<[^=]*>)?\s*="),
    ("enum", r"(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)"),
    ("function", r"(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b\s*)?(?P<params>\()(?=[^;]*?(?:=>|\)\s*\{))"),
]
_C = [
    ("struct", r"(?:typedef\s+)?struct\s+(?P<name>\w+)\s*(?=\{|:)"),
    ("enum", r"(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)\s*(?=\{|:)"),
    ("class", r"(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)[^;{()]*(?=\{)"),
    ("function", r"(?!return\b|else\b|if\b|for\b|while\b|switch\b)(?:[\w:*&<>,~]+[\s*&]+)+(?P<name>~?\w+(?:::~?\w+)*)\s*(?P<params>\()(?=[^;{]*\{)"),
]
DECLARATIONS = {
    "Rust": [
        ("function", r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>\w+)\s*(?:<[^({]*>)?\s*(?P<params>\()"),
        ("struct", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"),
        ("enum", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"),
        ("trait", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"),
        ("module", r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"),
        ("type", r"(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"),
        ("constant", r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:"),
        ("impl", r"(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[^{;]*?\bfor\s+)?(?P<name>\w+)"),
    ],
    "TypeScript": _JS,
    "JavaScript": _JS,
    "Go": [
        ("method", r"func\s+\([^)]*\)\s*(?P<name>\w+)\s*(?:\[[^\]]*\])?(?P<params>\()"),
        ("function", r"func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?(?P<params>\()"),
        ("interface", r"type\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s+interface\b"),
        ("struct", r"type\s+(?P<name>\w+)\s"),
    ],
    "Java": [
        ("class", r"(?:@\w+\s+)*(?:(?:public|private|protected|abstract|final|static|sealed)\s+)*(?:class|record)\s+(?P<name>\w+)"),
        ("interface", r"(?:(?:public|private|protected|static|sealed)\s+)*interface\s+(?P<name>\w+)"),
        ("enum", r"(?:(?:public|private|protected|static)\s+)*enum\s+(?P<name>\w+)"),
        ("method", r"(?!return\b|new\b|else\b|throw\b)(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?(?:[\w.<>\[\],?]+\s+)?(?P<name>\w+)\s*(?P<params>\()(?=[^;{]*\{)"),
    ],
    "C": _C,
    "C++": _C,
}
#: Kinds whose members are declarations of their own, and the kind that a member function has.
MEMBERS = {"Rust": {"impl"}, "TypeScript": {"class"}, "JavaScript": {"class"}, "Java": {"class"}}
_JS_METHOD = ("method", r"(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*[#*]?(?P<name>\w+)\s*(?:<[^>{]*>)?(?P<params>\()(?=[^;{]*\{)")
IMPORTS = {
    "Rust": r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", "TypeScript": r"(?m)^\s*import\b[^'\"\n]*['\"]([^'\"]+)['\"]", "JavaScript": r"(?m)^\s*import\b[^'\"\n]*['\"]([^'\"]+)['\"]",
    "Go": r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$", "Java": r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "C": r"(?m)^\s*#\s*include\s*([<\"][^>\"\n]+[>\"])", "C++": r"(?m)^\s*#\s*include\s*([<\"][^>\"\n]+[>\"])",
}
_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`(?:[^`\\]|\\.)*`", re.S)
_DOC = re.compile(r"(?:^[ \t]*(?://[^\n]*|/\*.*?\*/)[ \t]*\n)+\Z", re.S | re.M)


def blanked(source: str) -> str:
    """The source with comments and strings as blanks, line ends and length kept."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def closing(code: str, at: int, pair: str) -> int:
    """Index after the bracket that closes the one at ``at``, or the end."""
    depth = 0
    for m in re.finditer(f"[{re.escape(pair)}]", code[at:]):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return at + m.end()
    return len(code)


def clean_comment(raw: str) -> str | None:
    """A comment's words without its markers, lines joined by a blank."""
    out = [re.sub(r"^\s*(?:///?!?|/\*\*?|\*/|\*|#)?\s?|\s*\*/\s*$", "", x).strip() for x in raw.strip().split("\n")]
    return " ".join(x for x in out if x) or None


def parameter(language: str, raw: str) -> tuple | None:
    raw = raw.strip()
    if not raw or raw in ("void", "...") or language == "JavaScript":
        return None
    optional = "=" in raw or re.match(r"\w+\?", raw) is not None
    if language in ("Rust", "TypeScript"):
        name, _, kind = raw.split("=")[0].partition(":")
        return (re.sub(r"^mut\s+|\?$", "", name.strip()) if name.strip() not in ("&mut self",) else "&mut self", kind.strip() or None, optional)
    words = re.split(r"[\s*&]+", raw.split("=")[0].strip())
    if language == "Go":
        return (words[0], " ".join(words[1:]) or None, False)
    return (words[-1], raw[: raw.rfind(words[-1])].strip() or None, optional) if len(words) > 1 else (words[0], None, optional)


def split_top(text: str) -> list[str]:
    """Text cut at commas outside of brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "([{<"
        depth -= c in ")]}>" and text[i - 1 : i + 1] not in ("->", "=>")
        if c == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


class _Source:
    def __init__(self, text: str):
        self.text, self.starts = text, [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def bytes(self, at: int) -> int:
        return at if self.ascii else len(self.text[:at].encode("utf-8", "surrogatepass"))


def _row(src: _Source, a: int, b: int, name, kind, doc, parameters, returns, parent, visibility, body) -> dict:
    text = src.text[a:b]
    depth = most = 0
    for c in re.findall(r"[{}]", body or ""):
        depth += 1 if c == "{" else -1
        most = max(most, depth)
    return {
        "name": name, "kind": kind, "start_line": src.line(a), "end_line": src.line(max(a, b - 1)), "start_col": a - src.starts[src.line(a) - 1], "byte_start": src.bytes(a), "byte_end": src.bytes(b),
        "source_text": text, "doc_comment": doc, "signature": text.split("\n", 1)[0], "parameters": parameters, "return_type": returns, "parent": parent, "visibility": visibility, "body_text": body,
        "cyclomatic": 1 + len(re.findall(BRANCHES, body or "")), "max_nesting": max(0, most - 1),
    }


def _visibility(language: str, head: str, name: str) -> str:
    if language == "Rust":
        return "Public" if head.startswith("pub") else "Private"
    if language in ("TypeScript", "JavaScript"):
        return "Public" if head.startswith("export") else "Private" if "private" in head or name.startswith("#") else "Default"
    if language == "Java":
        return "Public"
    return ("Public" if name[:1].isupper() else "Private") if language == "Go" else "Default"


def declared(language: str, source: str) -> list[dict]:
    """Symbols of a brace language, in order of their place."""
    src, code, out = _Source(source), blanked(source), []

    def scan(a: int, b: int, parent: str | None, table: list) -> None:
        patterns = [(kind, re.compile(r"^[ \t]*(?P<head>" + p + ")", re.M)) for kind, p in table]
        at = a
        while at < b:
            found = [(m.start("head"), i, kind, m) for i, (kind, p) in enumerate(patterns) if (m := p.search(code, at, b))]
            if not found:
                return
            start, _, kind, m = min(found, key=lambda x: x[:2])
            end_of_params = closing(code, m.start("params"), "()") if m.groupdict().get("params") else m.end()
            stop = re.compile(r"[{;]" if kind not in ("type", "constant") else r";|\n\s*\n|\Z").search(code, end_of_params, b)
            if stop is None:
                end, body = b, None
            elif stop[0] == "{":
                end = closing(code, stop.start(), "{}")
                body = source[stop.start() : end]
            else:
                end, body = stop.end(), None
            name = m["name"]
            if kind == "impl" or (kind in MEMBERS.get(language, ()) and body):
                if kind != "impl":
                    add(start, end, name, kind, m, parent, None, end_of_params, stop)
                inner = [*table, _JS_METHOD] if language in ("TypeScript", "JavaScript") else table
                scan(stop.end() if stop else end, end - 1, name, inner)
            else:
                add(start, end, name, "method" if kind == "function" and parent else kind, m, parent, body, end_of_params, stop)
            at = max(end, m.end())

    def add(start, end, name, kind, m, parent, body, end_of_params, stop) -> None:
        params = [p for x in split_top(source[m.start("params") + 1 : end_of_params - 1]) if (p := parameter(language, x))] if m.groupdict().get("params") else []
        returns = source[end_of_params : stop.start()].strip() if stop and m.groupdict().get("params") else ""
        returns = re.sub(r"^(?:->|:|=>)\s*|\s*=>$", "", returns).strip() or None
        doc = _DOC.search(source[: src.starts[src.line(start) - 1]])
        out.append(_row(src, start, end, name, kind, clean_comment(doc[0]) if doc else None, params, returns if language in ("Rust", "TypeScript", "Go") else None, parent, _visibility(language, m["head"], name), body))

    scan(0, len(code), None, DECLARATIONS[language])
    return out


def declared_python(source: str) -> list[dict]:
    """Functions, classes and methods of a Python file; nested functions are part of
    the outer one. A file that doesn't parse has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    src, out = _Source(source), []

    def place(line: int, col: int) -> int:
        row = source[src.starts[line - 1] :].split("\n", 1)[0]
        return src.starts[line - 1] + len(row.encode()[:col].decode(errors="ignore"))

    def visit(nodes: list, parent: str | None) -> None:
        for n in nodes:
            if not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            a, b = place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset)
            body = source[place(n.body[0].lineno, n.body[0].col_offset) : b]
            private = "Private" if n.name.startswith("_") else "Public"
            doc = ast.get_docstring(n)
            if isinstance(n, ast.ClassDef):
                out.append(_row(src, a, b, n.name, "class", doc, [], None, parent, private, None))
                visit(n.body, n.name)
            else:
                args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
                given = len(args) - len(n.args.defaults) - len(n.args.kwonlyargs)
                params = [(x.arg, ast.unparse(x.annotation) if x.annotation else None, i >= given) for i, x in enumerate(args) if x.arg not in ("self", "cls")]
                out.append(_row(src, a, b, n.name, "method" if parent else "function", doc, params, ast.unparse(n.returns) if n.returns else None, parent, private, body))

    visit(tree.body, None)
    return out


def imported(language: str, source: str) -> list[tuple[str, bool]]:
    if language == "Python":
        try:
            nodes = [n for n in ast.parse(source).body if isinstance(n, ast.Import | ast.ImportFrom)]
        except (SyntaxError, ValueError, RecursionError):
            return []
        return [(s := ast.unparse(n), "*" in s) for n in nodes]
    if language == "Go":
        groups = re.findall(r"(?s)^import\s*\((.*?)^\s*\)", source, re.M) + re.findall(r"(?m)^import\s+[^(\n].*$", source)
        return [(p, False) for g in groups for p in re.findall(IMPORTS["Go"], g)]
    return [(" ".join(x.split()), "*" in x) for x in re.findall(IMPORTS[language], source)]


#: Goes up whenever results for the same source change; kept analyses are of one version.
VERSION = 1
_struct = lambda ddl: "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl) + ">"
ANALYSIS = f"content_hash long, language string, symbols array<{_struct(SYMBOL)}>, imports array<{_struct(IMPORT)}>"


def sources(files: DataFrame) -> DataFrame:
    """The files that are analysed: in one of ``LANGUAGES`` and with content."""
    return files.where(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull())


def parsed(contents: DataFrame) -> DataFrame:
    """``ANALYSIS`` of (content_hash, language, content); contents that can't be read
    have no symbols."""

    def run(batches):
        for pdf in batches:
            rows = []
            for language, source in zip(pdf.language, pdf.content, strict=True):
                rows.append((declared_python(source) if language == "Python" else declared(language, source), [{"source": s, "is_wildcard": w} for s, w in imported(language, source)]))
            yield pd.DataFrame({"content_hash": pdf.content_hash, "language": pdf.language, "symbols": [r[0] for r in rows], "imports": [r[1] for r in rows]})

    return contents.select("content_hash", "language", "content").mapInPandas(run, ANALYSIS)


def of_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """Analyses by content as analyses by file."""
    return sources(files).select("path", "file_pos", "language", "content_hash").join(found, ["content_hash", "language"]).select("path", "file_pos", "language", "symbols", "imports")


def analysed(files: DataFrame) -> DataFrame:
    """(path, file_pos, language, symbols, imports) for files (path, file_pos,
    language, content, content_hash) in one of ``LANGUAGES``.

    Contents that several files share are analysed once for each language. Null
    contents are left out; contents that can't be read have no symbols.
    """
    return of_files(files, parsed(sources(files).dropDuplicates(["content_hash", "language"])))


def symbols(analyses: DataFrame) -> DataFrame:
    """A row for each symbol: path, file_pos, language, sym_pos and its fields."""
    return analyses.select("path", "file_pos", "language", F.posexplode("symbols").alias("sym_pos", "s")).select("path", "file_pos", "language", "sym_pos", "s.*")


def imports(analyses: DataFrame) -> DataFrame:
    return analyses.select("path", "file_pos", "language", F.posexplode("imports").alias("imp_pos", "i")).select("path", "file_pos", "language", "imp_pos", "i.*")


def symbol_table(analyses: DataFrame) -> DataFrame:
    """(path, exports, dependencies, n_symbols): names and import sources by file."""
    return analyses.select("path", F.transform("symbols", lambda s: s["name"]).alias("exports"), F.transform("imports", lambda i: i["source"]).alias("dependencies"), F.size("symbols").alias("n_symbols"))
