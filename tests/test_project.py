"""From a small source tree to formatted samples."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslathe.operators import dedup, quality, relations, statistics, symbols
from corpuslathe.plans import pipeline
from corpuslathe.plans.config import FORMATS, SAMPLE_TYPES, Config, Ignore, Quality
from corpuslathe.sinks import export, formats
from corpuslathe.sources import scan

PY = '''import os
from pkg.util import load_items


class Store:
    """Keeps items."""

    def get_item(self, key: str, default=None) -> str:
        """Finds an item."""
        if key in self.items:
            return self.items[key]
        try:
            return load_items(key)
        except Exception:
            return default

    def _hidden(self):
        pass


def read_all(paths, limit=10, *, deep: bool = False):
    out = []
    for p in paths:
        if os.path.exists(p) and len(out) < limit:
            out.append(p)
        # TODO: links
    total = 0
    for o in out:
        total += 1
    if deep:
        total += 2
    if total > 3:
        total = 3
    a = 1
    b = 2
    return out, total, a, b
'''
RS = '''use std::fs;

/// Adds two numbers.
pub fn add(a: i32, b: i32) -> i32 {
    let s = "}";
    let c = a + b;
    c
}

struct Point {
    x: i32,
}

impl Point {
    /// Makes é.
    pub fn new(x: i32) -> Self {
        let p = Point { x };
        p.clone().clone().clone();
        p
    }
}
'''
TS = '''import { add } from "./add";

/** A box. */
export class Box {
  private size: number;
  constructor(size: number) {
    this.size = size;
  }
  grow(by: number): number {
    if (by == 0) { return this.size; }
    console.log(by);
    return this.size + by;
  }
}
export const area = (w: number, h: number): number => {
  return add(w, h);
};
interface Shape { name: string }
'''
GO = 'package main\n\nimport (\n\t"fmt"\n)\n\n// Run runs.\nfunc Run(n int) error {\n\tfmt.Println(n)\n\treturn nil\n}\n\ntype Thing struct {\n\tA int\n}\n'
C = '#include <stdio.h>\n\nstruct node { int x; };\n\nint main(int argc, char **argv) {\n  printf("{");\n  return 0;\n}\n'
JAVA = 'import java.util.List;\n\npublic class Main {\n  /** Says it. */\n  public String say(String what, int n) {\n    if (n > 0) {\n      return what;\n    }\n    return "";\n  }\n}\n'


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "pkg/__init__.py": "", "pkg/_x.py": PY, "pkg/copy.py": PY, "src/lib.rs": RS, "src/box.ts": TS, "src/run.go": GO, "src/main.c": C, "src/Main.java": JAVA, "pyproject.toml": "[x]\n",
        "README.md": "# T\n\n[![b](https://img.shields.io/x)](y)\n\nA *small* [tree](u) of `code`. It has files.\n", ".env": "x", "secret.pem": "x", "node_modules/a.js": "x", "logs/a.log": "x",
        ".gitignore": "logs/\n*.tmp\n", "a.tmp": "x", ".hidden/b.py": "x",
    }
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "bin.py").write_bytes(b"a\0b")
    (root / "big.py").write_bytes(b"#" * 1_000_001)
    (root / "link.py").symlink_to(root / "pkg/_x.py")
    return root


@pytest.fixture(scope="module")
def ctx(spark, tree, tmp_path_factory):
    return pipeline.project_tables(spark, str(tree), "demo", str(tmp_path_factory.mktemp("work")), "A demo")


def test_scan(ctx):
    rows = {r.path: r for r in ctx.files.collect()}
    assert sorted(rows) == ["README.md", "pkg/__init__.py", "pkg/_x.py", "pkg/copy.py", "pyproject.toml", "src/Main.java", "src/box.ts", "src/lib.rs", "src/main.c", "src/run.go"]
    assert [rows[p].file_pos for p in sorted(rows)] == list(range(10))
    assert rows["pkg/_x.py"].language == "Python" and rows["src/lib.rs"].language == "Rust" and rows["src/main.c"].language == "C"
    assert rows["pkg/_x.py"].content_hash == rows["pkg/copy.py"].content_hash
    assert rows["pkg/__init__.py"].line_count == 0 and rows["src/run.go"].line_count == 15


def test_scan_settings(spark, tmp_path):
    root = tmp_path / "tree"
    deep = "/".join(f"d{i}" for i in range(6))
    files = {
        f"{deep}/x.py": "x = 1\n" * 4, f"{deep}/y.log": "y", f"{deep}/keep.log": "k", ".gitignore": "*.log\n", f"{deep}/.gitignore": "!keep.log\n", ".git/info/exclude": "own/\n", "own/a.py": "a = 1\n",
        "gen.py": "# Code generated by x. DO NOT EDIT.\na = 1\n", "long.py": "def f():\n    return 1\n" * 30, "notes.skip": "n", "private.key": "k", "é.py": "e = 1\n" * 4,
        **{f"many/{i:03}.txt": "t" for i in range(150)},
    }
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)

    def scanned(**settings):
        rows = scan.project_files(spark, str(root), **settings).orderBy("file_pos").collect()
        assert [r.file_pos for r in rows] == list(range(len(rows)))
        assert [r.path for r in rows] == sorted((r.path for r in rows), key=str.encode)
        assert all(files[r.path] == r.content for r in rows)
        return {r.path for r in rows}

    every = {p for p in files if not p.startswith(".") and not p.endswith("/.gitignore")}
    assert scanned() == every - {f"{deep}/y.log", "own/a.py", "private.key"}
    assert scanned(use_gitignore=False, extra=("*.skip", "many")) == {p for p in every if p not in ("notes.skip", "private.key") and not p.startswith("many/")}
    assert scanned(sensitive=False, max_bytes=1) == {p for p in every if len(files[p]) == 1 and not p.endswith("y.log")}
    (tmp_path / "none").mkdir()
    assert scan.project_files(spark, str(tmp_path / "none")).isEmpty()
    with pytest.raises(NotADirectoryError):
        scan.project_files(spark, str(root / "gen.py"))

    config = Config(ignore=Ignore(user_patterns=("many",)), quality=Quality(skip_generated=True, max_line_count=50))
    ctx = pipeline.project_tables(spark, str(root), "p", str(tmp_path / "work"), config=config)
    assert {r.path for r in ctx.analyses.collect()} == {f"{deep}/x.py", "é.py"} and {"gen.py", "long.py"} <= {r.path for r in ctx.files.collect()}


def test_sources_passed(spark):
    rows = [("a.lock", "x\ny\nz\nw\n", 4), ("api.generated.ts", "x\n" * 9, 9), ("c.py", "# c\n" * 9, 9), ("d.py", "d = 1\n" * 9, 9), ("e.py", None, 0)]
    files = spark.createDataFrame(rows, "path string, content string, line_count int")
    names = lambda **settings: {r.path for r in quality.sources_passed(files, Quality(**settings)).collect()}
    assert len(names()) == 5 and names(skip_generated=True) == {"c.py", "d.py", "e.py"}
    assert names(skip_boilerplate=True) == {"a.lock", "api.generated.ts", "d.py", "e.py"} and names(max_line_count=5) == {"a.lock", "e.py"}
    for wrong in (lambda: Quality(max_line_count=1), lambda: Ignore(max_file_bytes=0)):
        with pytest.raises(ValueError):
            wrong()


def test_card_and_outputs(spark, tmp_path):
    from datetime import datetime

    for style, columns in formats.FEATURES.items():
        text = export.card("a: b", "About", "mit", (style,), [], dict.fromkeys(("sum", "min", "max", "mean", "median", "p90", "p99"), 0), datetime(2026, 1, 1))
        front = text.split("---")[1]
        assert all(f"  - name: {c}\n" in front for c in columns) and "    num_examples: 0" in front and 'pretty_name: "a - b Training Data"' in front
        assert formats.BLURBS[style] in text
    spark.createDataFrame([('{"a": 1}',), ("{}",)], "value string").write.text(str(tmp_path / "good"))
    spark.createDataFrame([('{"a": 1}',), ("no",)], "value string").write.text(str(tmp_path / "bad"))
    assert export.validated(spark, [str(tmp_path / "good")]) == [str(tmp_path / "good")]
    with pytest.raises(ValueError):
        export.validated(spark, [str(tmp_path / "bad")])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        export.validated(spark, [str(tmp_path / "absent")])


def test_discover_and_description(spark, tree, ctx):
    (found,) = scan.discover(spark, str(tree)).collect()
    assert found.project_type == "python" and found.has_readme
    readme = ctx.files.where("path = 'README.md'")
    assert scan.description(readme).first().description == "A small tree of `code`. It has files."


def test_symbols(ctx):
    found = {(r.path, r.name): r for r in ctx.symbols.collect()}
    kinds = {k: r.kind for k, r in found.items()}
    for key, kind in {
        ("pkg/_x.py", "Store"): "class", ("pkg/_x.py", "get_item"): "method", ("pkg/_x.py", "read_all"): "function", ("src/lib.rs", "add"): "function", ("src/lib.rs", "Point"): "struct",
        ("src/lib.rs", "new"): "method", ("src/box.ts", "Box"): "class", ("src/box.ts", "grow"): "method", ("src/box.ts", "area"): "function", ("src/box.ts", "Shape"): "interface",
        ("src/run.go", "Run"): "function", ("src/run.go", "Thing"): "struct", ("src/main.c", "main"): "function", ("src/main.c", "node"): "struct", ("src/Main.java", "Main"): "class", ("src/Main.java", "say"): "method",
    }.items():
        assert kinds[key] == kind, key
    for r in found.values():  # spans are bytes of the file
        text = next(x.content for x in ctx.files.where(F.col("path") == r.path).collect())
        assert text.encode()[r.byte_start : r.byte_end].decode() == r.source_text
    add = found["src/lib.rs", "add"]
    assert add.doc_comment == "Adds two numbers." and add.visibility == "Public" and add.return_type == "i32" and [p.name for p in add.parameters] == ["a", "b"]
    assert found["src/lib.rs", "new"].parent == "Point" and found["src/lib.rs", "new"].doc_comment == "Makes é."
    get = found["pkg/_x.py", "get_item"]
    assert get.doc_comment == "Finds an item." and [(p.name, p.type_annotation, p.is_optional) for p in get.parameters] == [("key", "str", False), ("default", None, True)] and get.cyclomatic > 2
    sources = {(r.path, r.source) for r in ctx.imports.collect()}
    assert {("src/lib.rs", "std::fs"), ("src/box.ts", "./add"), ("src/run.go", "fmt"), ("src/main.c", "<stdio.h>"), ("src/Main.java", "java.util.List"), ("pkg/_x.py", "import os")} <= sources
    table = {r.path: r for r in symbols.symbol_table(ctx.analyses).collect()}
    assert table["src/run.go"].exports == ["Run", "Thing"]


def test_relations(ctx):
    hits = {(r.path, r.name) for r in ctx.hits.collect()}
    texts = {r.path: r.text for r in ctx.searched.collect()}
    names = {r.name for r in ctx.symbols.collect()}
    assert hits == {(p, n) for p, t in texts.items() for n in names if n in t}
    refs = {(r.path, r.sym_pos): r.referencing for r in relations.referencing_files(ctx.symbols, ctx.hits, ctx.analyses).collect()}
    order = [r.path for r in ctx.analyses.orderBy("file_pos").collect()]
    for s in ctx.symbols.collect():
        assert refs.get((s.path, s.sym_pos), []) == [p for p in order if p != s.path and s.name in texts[p]][:3]


@pytest.mark.parametrize("at_once", [1, 3, 1000])
def test_mentions_in_parts(spark, monkeypatch, at_once):
    """Names in one part or in many, none of them, and texts without any."""
    monkeypatch.setattr(relations, "NAMES_AT_ONCE", at_once)
    names = ["add", "dd", "a", "é日", "x y", "never", "", None, "add"]
    texts = [("t1", "add it, add é日 to x y"), ("t2", "nothing"), ("t3", None), ("t4", ""), (None, "odd add"), ("t1", "dd")]
    got = relations.mentions(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(texts, "path string, text string"))
    assert {(r.path, r.name) for r in got.collect()} == {(p, n) for p, t in texts for n in names if n and t and n in t}
    assert relations.mentions(spark.createDataFrame([], "name string"), spark.createDataFrame(texts, "path string, text string")).count() == 0


def test_pipeline_and_formats(spark, ctx, tmp_path):
    got = pipeline.run(ctx, str(tmp_path / "w"), Config(enabled_types=SAMPLE_TYPES))
    samples = got.samples.collect()
    assert len({s.ord for s in samples}) == len(samples) and len({s.sample_key for s in samples}) == len(samples)
    assert {s.sample_type for s in samples} == set(SAMPLE_TYPES)
    assert all(t.content is not None for s in samples for t in s.conversation)
    fill = next(s for s in samples if s.sample_type == "CodeCompletion" and s.metadata.symbol_name == "add")
    assert "-> i32 <FILL>" in fill.conversation[1].content and fill.conversation[2].content.startswith("```rust\n{\n")
    kept = got.kept.collect()
    assert 0 < len(kept) < len(samples)  # copy.py repeats _x.py
    for style in FORMATS:
        for r in formats.formatted(got.samples, style).select("line", "sample_type").collect():
            assert isinstance(json.loads(r.line), dict)
    calls = formats.formatted(got.samples.where("sample_type = 'ToolCalling'"), "Llama4").first().line
    assert "[read_file(end_line=" in json.loads(calls)["text"]
    n = statistics.quality_counters(got.judged, got.kept).first()
    assert n.total_input == len(samples) and n.passed == len(kept) and n.filtered + n.pre_dedup_count == n.total_input
    from datetime import datetime

    export.staged(spark, got.kept, str(tmp_path / "out"), "demo", "A demo: small", "mit", ("OpenAI", "ChatML"), datetime(2026, 1, 1))
    lines = spark.read.text(str(tmp_path / "out/data/openai")).collect()
    assert len(lines) == len(kept)
    assert "size_categories:" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/card")).collect())
    assert pipeline.preview(got.samples, 2, 3).count() == 3 and pipeline.preview(got.samples, 10_000, 3).count() == 0


def test_greedy_keep_first(spark):
    # a chain keeps both ends; a component rule would keep one
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (5, 7), (6, 7), (7, 8)], "i long, j long")
    assert sorted(r.ord for r in dedup.removed(edges).collect()) == [2, 6, 7]


def test_dedup_equals_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("ord"), "text")
    got = {r.ord for r in dedup.deduplicated(docs, F.col("text")).collect()}
    rows = sorted((r.ord, r.text) for r in docs.collect())
    a, b = dedup.seeds()
    signed = {o: dedup.signature(dedup.shingle_hashes(t), a, b) for o, t in rows}
    gone: set = set()
    for i, (x, _) in enumerate(rows):
        for y, _ in rows[i + 1 :]:
            s, t = signed[x], signed[y]
            banded = any((s[k : k + 8] == t[k : k + 8]).all() for k in range(0, 128, 8))
            if x not in gone and y not in gone and banded and (s == t).mean() >= 0.85:
                gone.add(y)
    assert got == {o for o, _ in rows} - gone
    first = dedup.firsts(dedup.signatures(docs, "ord"))
    assert {r.ord for r in dedup.removed(dedup.links(first)).collect()} == {r.ord for r in dedup.removed_by_rounds(first).collect()}


def test_dedup_of_a_dense_bucket(spark, monkeypatch):
    """Texts of one template that share buckets and do not link, with some that do: a
    number of tables that does not grow with them, and the rule's result."""
    import random

    r = random.Random(1)
    same = " ".join(f"word{r.randrange(10**6)}" for _ in range(150))
    texts = [same + " " + " ".join(f"own{r.randrange(10**6)}" for _ in range(26)) for _ in range(300)]
    texts += [texts[k] + f" tail{i}" for i, k in enumerate((5, 5, 9, 250))] + [texts[3], ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    made, real = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df: made.append(1) or real(df))
    monkeypatch.setattr(dedup, "CHUNK", 64)
    got = {x.ord for x in dedup.deduplicated(docs, F.col("text")).collect()}
    a, b = dedup.seeds()
    signed = np.array([dedup.signature(dedup.shingle_hashes(t), a, b) for t in texts])
    banded = lambda i, j: (signed[i] == signed[j]).reshape(16, 8).all(1).any()
    gone: set = set()
    shared = 0
    for j in range(len(texts)):
        for i in range(j):
            if banded(i, j):
                shared += 1
                if i not in gone and (signed[i] == signed[j]).mean() >= 0.85:
                    gone.add(j)
    assert shared > 2000 and len(gone) >= 5 and got == set(range(len(texts))) - gone
    assert len(made) <= 2 + 3 * dedup.ROUNDS + 1 + 8
    first = dedup.firsts(dedup.signatures(docs))
    pairs = {(x.i, x.j) for x in dedup.links(first).collect()}
    heads = sorted(x.i for x in first.select("i").collect())
    assert pairs == {(i, j) for i in heads for j in heads if i < j and (signed[i] == signed[j]).mean() >= 0.85 and banded(i, j)}


def test_reasons(spark):
    turn = lambda role, content: (role, content, None, None, None)
    base = [turn("user", "Explain this part of the program to me, please, in a few words."), turn("assistant", "It reads a file, counts its words and prints the ten most common. " * 6)]
    cases = {
        None: base, "few tokens": base[:1], "empty turn": [*base, turn("user", " \n")], "long lines": [base[0], turn("assistant", "word " * 60)], "few letters": [base[0], turn("assistant", "== !! " * 20 + "\n" + "## " * 50)],
        "short code": [turn("user", "See\n```py\na\nb\n```\n" + base[0][1]), turn("assistant", "It is\n" * 60)],
    }
    from corpuslathe.plans.generators import TURN

    cases["long lines"][1] = turn("assistant", "word " * 100)
    rows = [(i, c) for i, c in enumerate(cases.values())]
    df = spark.createDataFrame(rows, f"ord long, conversation array<{TURN}>")
    got = [r.reject_reason for r in quality.with_reasons(df).orderBy("ord").collect()]
    assert got[1:] == list(cases)[1:], got


def test_session(spark, tree, tmp_path):
    from corpuslathe.plans.session import Session, shown_bytes, suggested_name

    s = Session(spark, str(tmp_path))
    p = s.scan(str(tree))
    assert p.project_type == "python" and p.description.startswith("A small tree") and p.totals.file_count == 10
    assert s.describe(p.id, "new").tables.description == "new" and s.get(p.id).description == "new"
    assert s.languages(p.id).first().language == "Python" and s.formats().count() == 6
    with pytest.raises(ValueError):
        s.update_config(formats=("None",))
    s.update_config(enabled_types=("CodeQA", "Documentation"))
    result = s.run(p.id)
    assert s.status["state"] == "complete" and result.kept.count() > 0
    assert sum(r.n for r in s.rejected(result).collect()) == result.judged.where("reject_reason is not null").count()
    counts, tokens = s.statistics(result.kept)
    assert tokens.n == result.kept.count() == sum(r.n for r in counts.where("dimension = 'type'").collect())
    assert s.preview(result.kept, 0, 2).count() == 2
    assert spark.read.text(s.publish(p.id, result.kept, "mit") + "/card").count() > 10
    assert suggested_name("My Tool!!") == "my-tool-training-data" and shown_bytes(2048) == "2.0 KB"
