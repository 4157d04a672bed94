"""Sample generators: each maps the tables of a project to samples.

A generator is a function of ``Tables`` and is one plan of projections and joins.
The wording of prompts and answers is fixed text; ``ord`` carries the total order
(generator, file, symbol, pattern) that later steps keep.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relations, symbols
from ..sinks.formats import compact

CALL = "struct<id:string,function_name:string,arguments:string>"
TURN = f"struct<role:string,content:string,tool_calls:array<{CALL}>,tool_call_id:string,name:string>"
TOOL = "struct<name:string,description:string,parameters:string>"
METADATA = "struct<language:string,symbol_name:string,symbol_kind:string,estimated_tokens:bigint,complexity_tier:string>"
COLUMNS = ["sample_key", "ord", "source_project", "source_files", "sample_type", "conversation", "tools", "metadata"]


def _tool(name: str, description: str, required: list[str], **properties: tuple[str, str]) -> tuple:
    given = {k: {"type": t, "description": d} for k, (t, d) in properties.items()}
    return name, description, compact({"type": "object", "properties": given, "required": required})


# The tools that samples know.
TOOLS = [
    _tool("read_file", "Read the contents of a file at the given path.", ["path"], path=("string", "The file path relative to the project root."), start_line=("integer", "Optional starting line number (1-indexed)."), end_line=("integer", "Optional ending line number (inclusive).")),
    _tool("search_code", "Search for a pattern across files in the project. Returns matching lines with file paths and line numbers.", ["pattern"], pattern=("string", "The search pattern (supports regex)."), file_glob=("string", "Optional glob to filter files (e.g., '*.rs', 'src/**/*.ts').")),
    _tool("list_directory", "List files and directories at the given path.", ["path"], path=("string", "The directory path relative to the project root."), recursive=("boolean", "Whether to list recursively. Default false.")),
    _tool("edit_file", "Make an edit to a file by replacing old text with new text.", ["path", "old_text", "new_text"], path=("string", "The file path relative to the project root."), old_text=("string", "The exact text to find and replace."), new_text=("string", "The replacement text.")),
    _tool("run_command", "Execute a shell command in the project directory.", ["command"], command=("string", "The shell command to execute.")),
    _tool("find_references", "Find all references to a symbol (function, class, variable) across the project.", ["symbol"], symbol=("string", "The symbol name to search for."), file_glob=("string", "Optional glob to narrow the search scope.")),
    _tool("get_symbol_info", "Get detailed information about a code symbol including its type, parameters, documentation, and location.", ["symbol"], symbol=("string", "The symbol name."), file=("string", "Optional file path to narrow the lookup.")),
    _tool("write_file", "Create a new file or completely overwrite an existing file.", ["path", "content"], path=("string", "The file path relative to the project root."), content=("string", "The complete file content to write.")),
]
READ_ONLY = ("read_file", "search_code", "list_directory", "find_references", "get_symbol_info")
ISSUES = {
    "unwrap": "Uses `.unwrap()` which will panic on `None`/`Err`. Consider using `.expect()` with a message or proper error handling with `?`.",
    "unsafe": "Contains `unsafe` block. Ensure memory safety invariants are upheld and document why `unsafe` is necessary.",
    "clone": "Multiple `.clone()` calls detected. Consider whether ownership can be restructured to avoid unnecessary cloning.",
    "any": "Uses `any` type annotation. This bypasses TypeScript's type checking. Consider using a more specific type or `unknown`.",
    "loose": "Uses loose equality (`==`) which performs type coercion. Prefer strict equality (`===`).",
    "console": "Contains `console.log` which should be removed before production.",
    "broad": "Catches broad exceptions. Consider catching specific exception types to avoid masking unexpected errors.",
    "eval": "Uses `eval()`/`exec()` which can execute arbitrary code. This is a security risk if input is not sanitized.",
    "ignored": "Ignores an error value. All errors should be handled or explicitly documented as intentionally ignored.",
    "todo": "Contains TODO/FIXME/HACK comments indicating incomplete or temporary code that should be addressed.",
    "handling": "No visible error handling in a substantial function. Consider adding input validation and error handling for robustness.",
}


@dataclass
class Tables:
    """A project's name and description, its files (path, file_pos, language,
    content) and their analyses."""

    project: str
    description: str
    files: DataFrame
    analyses: DataFrame

    @cached_property
    def symbols(self) -> DataFrame:
        own = symbols.symbols(self.analyses)
        return own.withColumns({"n_lines": T.line_count(F.col("source_text")), "fence": _fence8(F.col("language"))})

    @cached_property
    def imports(self) -> DataFrame:
        return symbols.imports(self.analyses)

    @cached_property
    def searched(self) -> DataFrame:
        return relations.searched_texts(self.analyses)

    @cached_property
    def hits(self) -> DataFrame:
        return relations.mentions(self.symbols.select("name"), self.searched)


def _fence8(language: Column) -> Column:
    return F.when(language.isin(*symbols.LANGUAGES), T.fence_name(language)).otherwise("")


def turn(role: str, content: Column | str, calls: Column | None = None, call_id: Column | None = None) -> Column:
    content = F.lit(content) if isinstance(content, str) else content
    none = F.lit(None)
    parts = {"role": F.lit(role), "content": content, "tool_calls": none if calls is None else F.array(calls), "tool_call_id": none if call_id is None else call_id, "name": none}
    return F.struct(*(v.alias(k) for k, v in parts.items())).cast(TURN)


def call(name: str, arguments: Column, key: Column) -> Column:
    """A tool call whose id follows from the sample's key."""
    return F.struct(F.concat(F.lit("call_"), F.substring(F.sha2(F.concat(key, F.lit(name)), 256), 1, 8)).alias("id"), F.lit(name).alias("function_name"), arguments.alias("arguments")).cast(CALL)


def read_only_tools() -> Column:
    return F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(("name", "description", "parameters"), t, strict=True))) for t in TOOLS if t[0] in READ_ONLY)).cast(f"array<{TOOL}>")


def _key(sample_type: str, ctx: Tables, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(sample_type), F.lit(ctx.project), *parts), 256)


def _samples(rows: DataFrame, ctx: Tables, rank: int, sample_type: str, pattern: Column | str, turns: list[Column], tokens: Column, tier: Column | str, files: Column | None = None, at: tuple[Column, Column] | None = None, tools: Column | None = None, symbol: bool = True, language: Column | None = None) -> DataFrame:
    a, b = at or (F.col("file_pos"), F.col("sym_pos") * 4 + (0 if pattern[-1] == "1" else 1))
    ord_ = F.shiftleft(F.lit(rank).cast("long"), 56) + F.shiftleft(a.cast("long"), 28) + b.cast("long")
    files = F.array("path") if files is None else files
    meta = F.struct(
        (F.col("language") if language is None else language).alias("language"), (F.col("name") if symbol else F.lit(None)).alias("symbol_name"), (F.col("kind") if symbol else F.lit(None)).alias("symbol_kind"),
        tokens.alias("estimated_tokens"), (F.lit(tier) if isinstance(tier, str) else tier).alias("complexity_tier"),
    ).cast(METADATA)
    key = _key(sample_type, ctx, F.lit(pattern) if isinstance(pattern, str) else pattern, F.array_join(files, ","), ord_.cast("string"))
    return rows.select(
        key.alias("sample_key"), ord_.alias("ord"), F.lit(ctx.project).alias("source_project"), files.cast("array<string>").alias("source_files"), F.lit(sample_type).alias("sample_type"),
        F.array(*turns).alias("conversation"), (F.lit(None).cast(f"array<{TOOL}>") if tools is None else tools).alias("tools"), meta.alias("metadata"),
    )


def _of(ctx: Tables, least: int, *kinds: str) -> DataFrame:
    return ctx.symbols.where(F.col("kind").isin(*kinds) & (F.col("n_lines") >= least))


def _named(p: Column) -> Column:
    return ~p["name"].isin("self", "&self", "&mut self")


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


# The texts of prompts and answers below are fixed values.
def _lines_tier() -> Column:
    return F.when(F.col("n_lines") < 10, "Simple").when(F.col("n_lines") < 40, "Moderate").otherwise("Complex")


def explanations(ctx: Tables) -> DataFrame:
    """Explanations of symbols."""
    rows = _of(ctx, 4, "function", "method", "class", "struct", "trait", "interface", "enum").withColumn("fence", T.fence_name(F.col("language")))
    kind, doc = F.col("kind"), F.regexp_replace("doc_comment", r"\.+$", "")
    about = f"Project description: {ctx.description}. " if ctx.description else ""
    system = T.template(f"You are an expert {{}} developer working on the {ctx.project.replace('{}', '')} project. {about.replace('{}', '')}Explain code clearly and concisely.", "language")
    code = T.template("\n\n```{}\n{}\n```", "fence", "source_text")
    callable_ = kind.isin("function", "method")
    question = F.concat(
        F.when(callable_, T.template("What does the `{}` {} in `{}` do?", "name", "kind", "path"))
        .when(kind == "enum", T.template("What is the purpose of the `{}` enum in `{}`?", "name", "path"))
        .otherwise(T.template("Explain the `{}` {} defined in `{}`.", "name", "kind", "path")),
        code,
    )
    said = F.concat(doc, F.lit("."))
    opening = (
        F.when(callable_, F.concat(T.template("The `{}` {}{} in `{}` ", "name", "kind", _or_empty(T.template(" on `{}`", "parent")), "path"), F.coalesce(said, F.concat(T.purpose_of_name(F.col("name")), F.lit(".")))))
        .when(kind.isin("class", "struct"), F.concat(T.template("`{}` is a {} defined in `{}`. ", "name", "kind", "path"), _or_empty(said)))
        .when(kind == "enum", F.concat(T.template("`{}` is an enum in `{}` that represents a set of distinct variants. ", "name", "path"), _or_empty(said)))
        .otherwise(F.concat(T.template("`{}` is a {} that defines a contract in `{}`. ", "name", "kind", "path"), _or_empty(said)))
    )
    each = F.transform("parameters", lambda p: F.concat(F.lit("`"), p["name"], F.lit("`"), _or_empty(F.concat(F.lit(" ("), p["type_annotation"], F.lit(")")))))
    takes = F.when(F.size("parameters") > 0, T.template("\n\nIt takes {} parameter(s): {}.", F.size("parameters"), F.array_join(each, ", "))).otherwise("")
    answer = F.concat(opening, takes, _or_empty(T.template(" It returns `{}`.", "return_type")))
    return _samples(rows, ctx, 0, "CodeQA", "explain1", [turn("system", system), turn("user", question), turn("assistant", answer)], T.quarter_bytes(F.col("source_text")), _lines_tier())


def usages(ctx: Tables) -> DataFrame:
    """Usage examples of the longer symbols."""
    kind = F.col("kind")
    longer = _of(ctx, 16, "function", "method", "class", "struct").withColumn("fence", T.fence_name(F.col("language")))
    names = F.array_join(F.transform(F.filter("parameters", lambda p: (kind == "function") | _named(p)), lambda p: p["name"]), ", ")
    use = usage(F.col("language"), kind, names)
    asked = T.template("How would you use the `{}` {} from `{}`? Show a practical example.\n\n```{}\n{}\n```", "name", "kind", "path", "fence", F.coalesce("signature", "source_text"))
    shown = T.template("Here's how you might use `{}` from `{}`:\n\n```{}\n{}```", "name", "path", "fence", use)
    expert = T.template("You are an expert {} developer. Provide clear, practical code examples.", "language")
    return _samples(longer, ctx, 0, "CodeQA", "usage2", [turn("system", expert), turn("user", asked), turn("assistant", shown)], T.quarter_bytes(F.col("source_text")), _lines_tier())


def code_qa(ctx: Tables) -> DataFrame:
    """Explanations of symbols, and usage examples of the longer ones."""
    return explanations(ctx).unionByName(usages(ctx))


#: How a language calls a function, makes an object and calls a method of it; Rust's are the fixed texts.
CALLS = {
    "Rust": ("let result = {}({});\n", "let instance = {}::new();\n", "instance.{}({});\n"), "Python": ("result = {}({})\n", "instance = {}()\n", "instance.{}({})\n"),
    "TypeScript": ("const result = {}({});\n", "const instance = new {}();\n", "instance.{}({});\n"), "JavaScript": ("const result = {}({});\n", "const instance = new {}();\n", "instance.{}({});\n"),
    "Go": ("result := {}({})\n", "instance := {}{}\n", "instance.{}({})\n"), "Java": ("var result = {}({});\n", "var instance = new {}();\n", "instance.{}({});\n"),
    "C": ("{}({});\n", "struct {} instance;\n", "{}({});\n"), "C++": ("auto result = {}({});\n", "{} instance;\n", "instance.{}({});\n"),
}


def usage(language: Column, kind: Column, names: Column) -> Column:
    """A call of the symbol in the syntax of its language; other languages are shown as Rust is."""

    def of(function: str, make: str, method: str) -> Column:
        made = lambda c: T.template(make, c, F.lit("{}")) if make.count("{}") == 2 else T.template(make, c)
        return (
            F.when(kind == "function", T.template(function, "name", names))
            .when(kind == "method", _or_empty(F.concat(made("parent"), T.template(method, "name", names))))
            .otherwise(made("name"))
        )

    out = of(*CALLS["Rust"])
    for name, texts in CALLS.items():
        out = F.when(language == name, of(*texts)).otherwise(out)
    return out


def doc_comment() -> Column:
    """A documentation comment in the style of the symbol's language."""
    language, params = F.col("language"), F.col("parameters")
    action = F.when(F.col("kind").isin("function", "method"), "performs an operation").when(F.col("kind").isin("class", "struct"), "represents a data structure").otherwise("is a code element")
    said = F.coalesce("doc_comment", T.template("`{}` {}", "name", action))
    of = lambda text, default, which=params: F.array_join(F.transform(which, lambda p: T.template(text, p["name"], F.coalesce(p["type_annotation"], F.lit(default)))), "")
    any_ = lambda text: F.when(F.size(params) > 0, text).otherwise("")
    own = F.filter(params, _named)
    listed = F.when(F.size(own) > 0, F.concat(F.lit("///\n/// # Arguments\n///\n"), of("/// * `{}` - {} parameter\n", "unspecified type", own))).otherwise("")
    rust = F.concat(T.template("/// {}\n", said), listed, _or_empty(T.template("///\n/// # Returns\n///\n/// {}\n", "return_type")))
    python = F.concat(T.template('    """{}\n\n', said), any_(F.concat(F.lit("    Args:\n"), of("        {} ({}): Description.\n", "Any"))), _or_empty(T.template("\n    Returns:\n        {}\n", "return_type")), F.lit('    """'))
    tag = F.array_join(F.transform(params, lambda p: F.concat(F.lit(" * @param {"), F.coalesce(p["type_annotation"], F.lit("*")), F.lit("} "), p["name"], F.lit(" - Description\n"))), "")
    js = F.concat(T.template("/**\n * {}\n", said), tag, _or_empty(F.concat(F.lit(" * @returns {"), F.col("return_type"), F.lit("}\n"))), F.lit(" */"))
    return F.when(language == "Rust", rust).when(language == "Python", python).when(language.isin("TypeScript", "JavaScript", "Java"), js).when(language == "Go", T.template("// {} {}", "name", said)).otherwise(T.template("// {}", said))


def documentation(ctx: Tables) -> DataFrame:
    """Documentation for symbols without it, better documentation for long ones."""
    rows = _of(ctx, 3, "function", "method", "class", "struct")
    tokens = T.quarter_bytes(F.col("source_text"))
    system = T.template("You are an expert {} developer. Write clear, comprehensive documentation following {} conventions.", "language", "language")
    asked = T.template("Write documentation for the following {} in `{}`:\n\n```{}\n{}\n```", "kind", "path", "fence", "source_text")
    tier = F.when(F.col("n_lines") > 30, "Complex").otherwise("Moderate")
    new = _samples(rows.where("doc_comment is null"), ctx, 1, "Documentation", "write1", [turn("system", system), turn("user", asked), turn("assistant", doc_comment())], tokens, tier)
    system = T.template("You are an expert {} developer. Improve documentation to be more comprehensive while keeping it concise.", "language")
    asked = T.template("Improve the documentation for this {} in `{}`.\n\nCurrent documentation:\n{}\n\nCode:\n```{}\n{}\n```", "kind", "path", "doc_comment", "fence", "source_text")
    shown = T.template("Here's improved documentation for `{}`:\n\n{}", "name", doc_comment())
    old = rows.where("doc_comment is not null and n_lines > 10")
    return new.unionByName(_samples(old, ctx, 1, "Documentation", "improve1", [turn("system", system), turn("user", asked), turn("assistant", shown)], tokens, "Moderate"))


def _bytes(text: Column, start: Column, length: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, length), "UTF-8")


def code_completion(ctx: Tables) -> DataFrame:
    """Function bodies to fill in between what stands before and after them."""
    body = F.col("body_text")
    rows = ctx.symbols.where(F.col("kind").isin("function", "method") & body.isNotNull() & (T.line_count(body) >= 3) & F.col("source_text").contains(body))
    rows = rows.join(ctx.files.select("path", "content"), "path")
    # the body ends the source, so its last match is its place; the signature may hold the same text
    last = F.length("source_text") - F.instr(F.reverse("source_text"), F.reverse(body)) - F.length(body) + 1
    before = F.octet_length(F.substr("source_text", F.lit(1), last))
    prefix = T.last_lines(_bytes(F.col("content"), F.lit(0), F.col("byte_start") + before), 50)
    suffix = T.first_lines(_bytes(F.col("content"), F.col("byte_end"), F.octet_length("content")), 20)
    rows = rows.withColumns({"prefix": prefix, "suffix": suffix})
    system = T.template("You are an expert {} developer. Complete the code by filling in the missing function body.", "language")
    asked = T.template("Complete the function body for the following code. The `<FILL>` marker shows where the code should be inserted.\n\n```{}\n{}<FILL>{}\n```", "fence", "prefix", "suffix")
    n = T.line_count(body)
    tokens = F.floor((F.octet_length("prefix") + F.octet_length(body) + F.octet_length("suffix")) / 4)
    tier = F.when(n > 20, "Complex").when(n > 8, "Moderate").otherwise("Simple")
    return _samples(rows, ctx, 2, "CodeCompletion", "body1", [turn("system", system), turn("user", asked), turn("assistant", T.template("```{}\n{}\n```", "fence", body))], tokens, tier)


def _arguments(**values: Column) -> Column:
    """JSON object with sorted keys."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))))


def _tool_lead(ctx: Tables) -> str:
    return f"You are a coding assistant for the {ctx.project.replace('{}', '')} project. "


def _tool_key(ctx: Tables) -> Column:
    return _key("ToolCalling", ctx, "path", F.col("file_pos").cast("string"))


def reading(ctx: Tables) -> DataFrame:
    """Functions read from their files and explained."""
    lead, key, tools = _tool_lead(ctx), _tool_key(ctx), read_only_tools()
    rows = _of(ctx, 5, "function", "method")
    read = rows.join(ctx.files.where("content is not null").select("path"), "path", "left_semi")
    listed = F.array_join(F.transform("parameters", lambda p: T.template("- `{}`: {}\n", p["name"], F.coalesce(p["type_annotation"], F.lit("unspecified")))), "")
    explained = F.concat(
        F.coalesce(T.template("The `{}` {} in `{}` {}.\n\n", "name", "kind", "path", "doc_comment"), T.template("The `{}` {} is defined in `{}`.\n\n", "name", "kind", "path")),
        F.when(F.size("parameters") > 0, F.concat(F.lit("**Parameters:**\n"), listed, F.lit("\n"))).otherwise(""), _or_empty(T.template("**Returns:** `{}`\n", "return_type")),
    )
    c = call("read_file", _arguments(path=F.col("path"), start_line=F.col("start_line"), end_line=F.col("end_line")), F.concat(key, F.col("sym_pos").cast("string")))
    turns = [
        turn("system", lead + "Use the provided tools to read files and answer questions about the codebase."), turn("user", T.template("Can you explain what the `{}` {} does in this project?", "name", "kind")),
        turn("assistant", T.template("Let me read the source code for `{}`.", "name"), c), turn("tool", F.col("source_text"), call_id=c["id"]), turn("assistant", explained),
    ]
    tier = F.when(F.col("n_lines") > 30, "Complex").otherwise("Moderate")
    return _samples(read, ctx, 3, "ToolCalling", "read1", turns, T.quarter_bytes(F.col("source_text")) + 200, tier, tools=tools)


def references(ctx: Tables) -> DataFrame:
    """Functions and the files that mention them."""
    lead, key, tools = _tool_lead(ctx), _tool_key(ctx), read_only_tools()
    found = _of(ctx, 9, "function", "method")
    refs = relations.referencing_files(found, ctx.hits, ctx.analyses)
    found = found.join(refs, ["path", "sym_pos"], "left").withColumn("referencing", F.coalesce("referencing", F.array().cast("array<string>")))
    n = F.size("referencing")
    usages = F.when(n == 0, "No other references found in the scanned files.\n").otherwise(F.array_join(F.transform("referencing", lambda r: F.concat(r, F.lit(":  (usage)\n"))), ""))
    summary = F.when(
        n == 0, T.template("`{}` is defined in `{}` at line {}. It doesn't appear to be referenced from other files in the current scope.", "name", "path", "start_line")
    ).otherwise(T.template("`{}` is defined in `{}` at line {} and is used in {} other file(s): {}.", "name", "path", "start_line", n, F.array_join("referencing", ", ")))
    c = call("search_code", _arguments(pattern=F.col("name")), F.concat(key, F.col("sym_pos").cast("string")))
    turns = [
        turn("system", lead + "Use tools to search the codebase and answer questions."), turn("user", T.template("Where is `{}` used in the project?", "name")),
        turn("assistant", T.template("Let me search for references to `{}`.", "name"), c), turn("tool", T.template("{}:{}  (definition)\n{}", "path", "start_line", usages), call_id=c["id"]), turn("assistant", summary),
    ]
    return _samples(found, ctx, 3, "ToolCalling", "references2", turns, F.lit(300), "Moderate", tools=tools)


def exploring(ctx: Tables) -> DataFrame:
    """Directories, once each, by their first file with symbols."""
    lead, key, tools = _tool_lead(ctx), _tool_key(ctx), read_only_tools()
    own = ctx.analyses.where(F.size("symbols") > 0).select("path", "file_pos", "language", T.parent_dir(F.col("path")).alias("dir"))
    own = own.groupBy("dir").agg(F.min(F.struct("file_pos", "path", "language")).alias("f")).select("f.path", "f.file_pos", "f.language", "dir")
    own = own.join(relations.siblings(ctx.analyses.select("path", "file_pos")), "dir").where(F.size("siblings") >= 2)
    c = call("list_directory", _arguments(path=F.col("dir")), key)
    summary = T.template("The `{}` directory contains {} file(s):\n\n{}", "dir", F.size("siblings"), F.array_join(F.transform("siblings", lambda s: F.concat(F.lit("- `"), s, F.lit("`"))), "\n"))
    turns = [
        turn("system", lead + "Use tools to explore the codebase structure."), turn("user", T.template("What files are in the `{}` directory?", "dir")),
        turn("assistant", T.template("Let me list the contents of `{}`.", "dir"), c), turn("tool", F.array_join("siblings", "\n"), call_id=c["id"]), turn("assistant", summary),
    ]
    return _samples(own, ctx, 3, "ToolCalling", "explore1", turns, F.lit(250), "Simple", files=F.col("siblings"), at=(F.col("file_pos"), F.lit(1 << 27)), tools=tools, symbol=False)


def tool_calling(ctx: Tables) -> DataFrame:
    """Reading and explaining, finding references, exploring directories."""
    return reading(ctx).unionByName(references(ctx)).unionByName(exploring(ctx))


def multi_turn(ctx: Tables) -> DataFrame:
    """Code reviews of two rounds."""
    rows = _of(ctx, 10, "function", "method")
    n, bare = F.col("n_lines"), F.col("doc_comment").isNull()
    points = F.filter(
        F.array(
            F.when(bare, T.template("The {} lacks documentation. Adding a doc comment explaining its purpose, parameters, and return value would improve maintainability.", "kind")),
            F.when(n > 30, T.template("At {} lines, this function is fairly long. Consider extracting some logic into helper functions to improve readability.", n)),
            F.when(F.size("parameters") > 4, T.template("This function takes {} parameters. Consider grouping related parameters into a struct or options object to simplify the interface.", F.size("parameters"))),
        ),
        lambda p: p.isNotNull(),
    )
    praise = F.array(T.template("The `{}` {} looks well-structured. The naming is clear and the logic is straightforward.", "name", "kind"))
    points = F.when(F.size(points) == 0, praise).otherwise(points)
    numbered = F.array_join(F.transform(points, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n\n")
    todo = F.array_join(F.transform(F.filter("parameters", _named), lambda p: T.template("/// * `{}` - TODO: describe this parameter", p["name"])), "\n")
    rust = T.template("Here's a documentation template:\n\n```rust\n/// TODO: Describe what `{}` does.\n///\n/// # Arguments\n///\n{}\n///\n/// # Returns\n///\n/// TODO: Describe the return value.\n```", "name", todo)
    python = T.template('Here\'s a docstring template:\n\n```python\ndef {}(...):\n"""TODO: Describe what {} does.\n\nArgs:\nTODO: Document parameters\n\nReturns:\nTODO: Document return value\n"""\n```', "name", "name")
    other = T.template("Here's a documentation template:\n\n```\n/**\n* TODO: Describe what {} does.\n*\n* @param ... - TODO: Document parameters\n* @returns TODO: Document return value\n*/\n```", "name")
    shorter = T.template("Here's how I'd approach refactoring `{}`:\n\n1. Identify the distinct responsibilities in the function\n2. Extract each into a well-named helper function\n3. The main function becomes an orchestrator that calls the helpers\n\nThis makes each piece independently testable and easier to understand.", "name")
    edges = T.template("For `{}`, consider these edge cases:\n\n1. What happens with empty or null inputs?\n2. Are there boundary conditions for numeric parameters?\n3. Could concurrent access cause issues?\n\nAdding input validation and clear error handling for these cases would make the code more robust.", "name")
    follow = F.when(bare, "Can you show me what the documentation should look like?").when(n > 30, "How would you refactor this to be shorter?").otherwise("Any edge cases I should handle?")
    reply = F.when(bare, F.when(F.col("language") == "Rust", rust).when(F.col("language") == "Python", python).otherwise(other)).when(n > 30, shorter).otherwise(edges)
    turns = [
        turn("system", T.template("You are a senior {} developer conducting a code review. Be constructive, specific, and suggest improvements where appropriate.", "language")),
        turn("user", T.template("Can you review this {} `{}`?\n\n```{}\n{}\n```", "kind", "name", "fence", "source_text")), turn("assistant", T.template("Here's my review of `{}`:\n\n{}", "name", numbered)),
        turn("user", follow), turn("assistant", reply),
    ]
    return _samples(rows, ctx, 4, "MultiTurn", "review1", turns, T.quarter_bytes(F.col("source_text")) + 400, F.when(n > 30, "Complex").otherwise("Moderate"))


def bug_detection(ctx: Tables) -> DataFrame:
    """Reviews that name what simple rules find."""
    code, language = F.col("source_text"), F.col("language")
    has = lambda *words: code.rlike("|".join(words))
    rust, js = language == "Rust", language.isin("TypeScript", "JavaScript")
    rules = {
        "unwrap": rust & code.contains(".unwrap()"), "unsafe": rust & (code.contains("unsafe {") | code.contains("unsafe{")), "clone": rust & (F.regexp_count(code, F.lit(r"\.clone\(\)")) > 2),
        "any": js & code.contains(": any"), "loose": js & code.contains("== ") & ~code.contains("=== "), "console": js & code.contains("console.log"),
        "broad": (language == "Python") & (code.contains("except:") | code.contains("except Exception:")), "eval": (language == "Python") & (code.contains("eval(") | code.contains("exec(")),
        "ignored": (language == "Go") & (code.contains("_ = err") | code.contains("_ =err")), "todo": has("TODO", "FIXME", "HACK"),
        "handling": (F.size("parameters") > 0) & ~has("Error", "error", "Result", "try", "catch", "except") & (F.col("n_lines") > 15),
    }
    found = F.filter(F.array(*(F.when(rule, ISSUES[k]) for k, rule in rules.items())), lambda i: i.isNotNull())
    rows = _of(ctx, 8, "function", "method").withColumn("issues", found).where(F.size("issues") > 0)
    listed = F.array_join(F.transform("issues", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n\n"))), "")
    turns = [
        turn("system", T.template("You are an expert {} developer specializing in code quality and bug detection. Identify potential issues, bugs, and improvements in the code.", "language")),
        turn("user", T.template("Review this {} for potential issues:\n\n```{}\n{}\n```", "kind", "fence", "source_text")), turn("assistant", T.template("I found {} potential issue(s) in `{}`:\n\n{}", F.size("issues"), "name", listed)),
    ]
    return _samples(rows, ctx, 5, "BugDetection", "bugs1", turns, T.quarter_bytes(code) + 200, "Moderate")


def overview(ctx: Tables) -> DataFrame:
    """An overview of the project: one sample, which lists all its files."""
    per_file = ctx.analyses.select("path", "file_pos", "language", F.size("symbols").alias("n"), F.transform(F.slice("symbols", 1, 3), lambda s: s["name"]).alias("names"))
    totals = per_file.agg(F.count("*").alias("n_files"), F.sum("n").alias("n_symbols"))
    head = per_file.orderBy("file_pos").limit(8).where("n > 0")
    line = T.template("- `{}` ({}) — defines: {}\n", "path", "language", F.array_join("names", ", "))
    key_files = head.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_pos", line.alias("line")))), lambda x: x["line"]), "").alias("key_files"))
    paths = ctx.analyses.agg(F.transform(F.sort_array(F.collect_list(F.struct("file_pos", "path"))), lambda x: x["path"]).alias("paths"))  # the sample itself lists all files
    one = totals.withColumn("k", F.lit(1)).join(key_files.withColumn("k", F.lit(1)), "k").join(paths.withColumn("k", F.lit(1)), "k").where("n_files >= 2 and n_symbols >= 3")
    about = f" — {ctx.description}" if ctx.description else ""
    text = F.concat(F.lit(f"**{ctx.project}**{about}\n\n"), T.template("The project contains {} source file(s) with {} symbol(s).\n\n**Key files:**\n{}", "n_files", "n_symbols", "key_files"))
    turns = [turn("system", "You are a senior developer. Provide clear, structured overviews of codebases."), turn("user", f"Give me an overview of the {ctx.project} project."), turn("assistant", text)]
    return _samples(one, ctx, 6, "RepoContext", "overview1", turns, F.lit(300), "Moderate", files=F.col("paths"), at=(F.lit(0), F.lit(0)), symbol=False, language=F.lit(None).cast("string"))


def interactions(ctx: Tables) -> DataFrame:
    """How pairs of related files interact."""
    pairs = relations.related_pairs(ctx.analyses, ctx.symbols, ctx.imports, ctx.hits)
    sources = ctx.analyses.select("path", F.array_join(F.transform("symbols", lambda s: s["source_text"]), "\u0000").alias("text"))
    named = relations.names_mentioned(ctx.symbols, sources, relations.mentions(ctx.symbols.select("name"), sources))
    none = F.array().cast("array<string>")
    pairs = pairs.join(named.toDF("a", "b", "a_in_b"), ["a", "b"], "left").join(named.toDF("b", "a", "b_in_a"), ["a", "b"], "left")
    pairs = pairs.join(ctx.analyses.select(F.col("path").alias("a"), "language"), "a").withColumns({"a_in_b": F.coalesce("a_in_b", none), "b_in_a": F.coalesce("b_in_a", none)})
    some = lambda c: F.when(F.size(c) == 1, "a symbol").otherwise("symbols")
    forth = F.when(F.size("a_in_b") > 0, T.template("`{}` defines {} which is referenced in `{}`: {}\n\n", "a", some("a_in_b"), "b", F.array_join("a_in_b", ", "))).otherwise("")
    back = F.when(F.size("b_in_a") > 0, T.template("`{}` defines {} referenced in `{}`: {}\n\n", "b", some("b_in_a"), "a", F.array_join("b_in_a", ", "))).otherwise("")
    neither = F.when(F.size("a_in_b") + F.size("b_in_a") == 0, "These files share related functionality but don't directly reference each other's exports.").otherwise("")
    turns = [
        turn("system", "You are a senior developer. Explain code architecture and module interactions clearly."), turn("user", T.template(f"How do `{{}}` and `{{}}` interact in the {ctx.project.replace('{}', '')} project?", "a", "b")),
        turn("assistant", F.concat(T.template("`{}` and `{}` are related modules in the project.\n\n", "a", "b"), forth, back, neither)),
    ]
    return _samples(pairs, ctx, 6, "RepoContext", "interaction1", turns, F.lit(350), "Complex", files=F.array("a", "b"), at=(F.col("a_pos"), F.col("b_pos")), symbol=False)


def repo_context(ctx: Tables) -> DataFrame:
    """An overview of the project, and how pairs of related files interact."""
    return overview(ctx).unionByName(interactions(ctx))


#: Open to further generators; the order is that of ``ord``.
GENERATORS: dict[str, Callable[[Tables], DataFrame]] = {
    "CodeQA": code_qa, "Documentation": documentation, "CodeCompletion": code_completion, "ToolCalling": tool_calling, "MultiTurn": multi_turn, "BugDetection": bug_detection, "RepoContext": repo_context,
}


def generated(ctx: Tables, enabled: tuple[str, ...], added: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """All samples of the enabled types, and of the table functions (sample type, name)
    that ``plugins.register`` made known."""
    from . import plugins

    out = None
    for name, generate in GENERATORS.items():
        if name in enabled:
            own = generate(ctx).select(*COLUMNS)
            out = own if out is None else out.unionByName(own)
    for i, (sample_type, name) in enumerate(added):
        own = plugins.generated_by(ctx, name, sample_type, len(GENERATORS) + i).select(*COLUMNS)
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no sample type is enabled")
    return out
