"""Languages, project types and files to leave out."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of languages, markers of project types (the first found
# counts), and names to leave out.
EXTENSIONS = {
    "Rust": "rs", "TypeScript": "ts tsx mts cts", "JavaScript": "js jsx mjs cjs", "Python": "py pyw pyi", "Go": "go", "Java": "java", "C": "c h",
    "C++": "cpp cc cxx hpp hxx hh", "C#": "cs", "Ruby": "rb", "Swift": "swift", "Kotlin": "kt kts", "PHP": "php", "Scala": "scala sc",
    "Shell": "sh bash zsh fish", "Lua": "lua", "Zig": "zig", "Elixir": "ex exs", "Haskell": "hs lhs", "OCaml": "ml mli", "Dart": "dart",
    "HTML": "html htm", "CSS": "css scss sass less", "SQL": "sql", "Markdown": "md markdown", "TOML": "toml", "YAML": "yaml yml", "JSON": "json jsonc",
}
FILE_NAMES = {"Makefile": "Makefile", "Dockerfile": "Dockerfile", "CMakeLists.txt": "CMake", "Gemfile": "Ruby", "Rakefile": "Ruby"}
SHEBANGS = {"python": "Python", "bash": "Shell", "sh": "Shell", "zsh": "Shell", "node": "JavaScript", "ruby": "Ruby", "lua": "Lua"}
ALIASES = {"TSX": "TypeScript", "JSX": "JavaScript", "SCSS": "CSS", "Sass": "CSS", "Less": "CSS", "PLpgSQL": "SQL", "PLSQL": "SQL", "TSQL": "SQL", "SQLPL": "SQL", "Bash": "Shell", "Zsh": "Shell", "fish": "Shell"}
MARKERS = [
    ("Cargo.toml", "rust"), ("package.json", "node"), ("pyproject.toml", "python"), ("setup.py", "python"), ("go.mod", "go"), ("pom.xml", "java"), ("build.gradle", "java"),
    ("build.gradle.kts", "kotlin"), ("Gemfile", "ruby"), ("Package.swift", "swift"), ("mix.exs", "elixir"), ("stack.yaml", "haskell"), ("dune-project", "ocaml"),
    ("pubspec.yaml", "dart"), ("composer.json", "php"), ("build.zig", "zig"), (".sln", "dotnet"), (".csproj", "dotnet"), ("Makefile", "make"), ("CMakeLists.txt", "cmake"),
    (".git", "git"),
]
IGNORED = (
    "node_modules target build dist out .next .nuxt .svelte-kit __pycache__ .pytest_cache vendor .venv venv env .git .hg .svn *.min.js *.min.css *.map "
    "*.lock package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock poetry.lock Pipfile.lock bun.lockb bun.lock *.pb.go *.generated.* *_generated.* *.d.ts "
    ".DS_Store Thumbs.db coverage .nyc_output .coverage htmlcov *.wasm *.so *.dylib *.dll *.a *.o *.obj *.exe *.jpg *.jpeg *.png *.gif *.svg *.ico *.webp "
    "*.mp3 *.mp4 *.wav *.avi *.webm *.zip *.tar *.gz *.bz2 *.7z *.rar *.pdf *.doc *.docx .idea .vscode *.swp *.swo"
).split()
SENSITIVE = ".env .env.* *.pem *.key *.p12 *.pfx *.keystore credentials.json service-account*.json .netrc .npmrc .pypirc".split()


def ignored_pattern(globs: list[str]) -> re.Pattern:
    return re.compile("|".join(fnmatch.translate(g) for g in globs) or r"(?!)")


#: Extensions that several languages share: patterns in a file's content and what each
#: says for a language. The largest sum counts; without one, the extension's own language.
CONTENT_SIGNS = {
    "h": [
        ("C++", 3, r"(?m)^\s*(?:class|namespace)\s+\w+[^;]*$"), ("C++", 3, r"(?m)^\s*template\s*<"), ("C++", 2, r"\bstd::|\w+::\w+\s*\("), ("C++", 2, r"(?m)^\s*(?:public|private|protected)\s*:"),
        ("C++", 2, r"(?m)^\s*using\s+(?:namespace\s+)?\w+"), ("C++", 1, r"\b(?:virtual|constexpr|noexcept|nullptr|operator)\b"), ("C++", 1, r"(?m)^\s*#\s*include\s*<[a-z_]+>"),
        ("C", 2, r"(?m)^\s*typedef\s+(?:struct|enum|union)\b"), ("C", 1, r"(?m)^\s*#\s*include\s*<[a-z/_]+\.h>"), ("C", 2, r"\b(?:malloc|calloc|free)\s*\("), ("C", 1, r"\bstruct\s+\w+\s*\*"),
    ],
    "ts": [("XML", 4, r"\A\s*<\?xml\b"), ("XML", 3, r"(?m)^\s*<!DOCTYPE\s+TS>"), ("TypeScript", 1, r"(?m)^\s*(?:import|export|const|let|function|interface|type|class)\b")],
    "m": [("Objective-C", 3, r"(?m)^\s*@(?:interface|implementation|import|protocol)\b"), ("Objective-C", 2, r"(?m)^\s*#\s*import\b"), ("MATLAB", 2, r"(?m)^\s*function\b[^{;]*$"), ("MATLAB", 1, r"(?m)^\s*%")],
    "pl": [("Prolog", 2, r"(?m)^[a-z]\w*\(.*\)\s*:-"), ("Prolog", 2, r"(?m)^:-\s*\w+"), ("Perl", 3, r"(?m)^\s*(?:use\s+(?:strict|warnings)|package\s+\w+|sub\s+\w+)"), ("Perl", 1, r"(?m)^\s*my\s+[$@%]")],
}


def by_content(extension: Column, content: Column) -> Column:
    """Language that the content of a file with a shared extension speaks for, by the sum
    of the weights of its signs, under this engine's name; ties go to the first listed
    language, null without any sign."""
    out = F.lit(None).cast("string")
    for name, signs in CONTENT_SIGNS.items():
        totals = {k: sum((F.when(content.rlike(p), w).otherwise(0) for lang, w, p in signs if lang == k), F.lit(0)) for k in dict.fromkeys(s[0] for s in signs)}
        best = F.greatest(*totals.values(), F.lit(1))
        said = F.coalesce(*(F.when(n == best, k) for k, n in totals.items()))
        out = F.when(extension == name, said).otherwise(out)
    return mapped_name(out)


def language(path: Column, content: Column | None = None) -> Column:
    """Language by file name, then by content where languages share the extension, then
    by extension, then by the interpreter of the first line."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    pairs = [F.lit(x) for k, v in EXTENSIONS.items() for e in v.split() for x in (e, k)]
    extension = F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1))
    by_extension = F.element_at(F.create_map(*pairs), extension)
    by_name = F.element_at(F.create_map(*(F.lit(x) for kv in FILE_NAMES.items() for x in kv)), name)
    if content is None:
        return F.coalesce(by_name, by_extension)
    program = F.regexp_extract(content, r"^#![^\n]*?([a-z]+)[0-9.]*\s*(?:\n|$)", 1)
    by_program = F.element_at(F.create_map(*(F.lit(x) for kv in SHEBANGS.items() for x in kv)), program)
    return F.coalesce(by_name, F.when(extension.isin(*CONTENT_SIGNS), by_content(extension, content)), by_extension, by_program)


def mapped_name(name: Column) -> Column:
    """A classifier's language name as this engine calls it."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), name), name)


def is_binary(content: Column) -> Column:
    """A zero byte in the first 8192 bytes, unless a UTF-16 or UTF-32 mark is first."""
    head = F.substring(content, 1, 8192)
    mark = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return (F.locate("00", F.regexp_replace(F.hex(head), "(..)", "$1 ")) > 0) & ~mark


def project_type(names: Column) -> Column:
    """Type of a folder that holds files of these names; null if none marks it."""
    out = F.lit(None).cast("string")
    for name, kind in reversed(MARKERS):
        ends = F.transform(names, lambda n: F.regexp_extract(n, r"(\.[^.]*)$", 1))
        found = F.array_contains(ends, name) if name in (".sln", ".csproj") else F.array_contains(names, name)
        out = F.when(found, kind).otherwise(out)
    return out
