"""The data source of trees and the sink of lines."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from corpuslathe.operators import statistics
from corpuslathe.sinks import commit, export, staging
from corpuslathe.sources import detect, scan, tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    files = {f"a/b{i % 3}/c{i % 5}/f{i}.py": f"x = {i}\n" * (i + 1) for i in range(60)}
    files |= {f"flat/n{i:03}.txt": "y" for i in range(90)} | {"top.md": "# T\n", "é/ü.py": "e = 1\n", "empty.txt": "", ".env": "s", "node_modules/m.js": "m", ".gitignore": "*.log\n", "a/x.log": "l", "a/b0/.gitignore": "f9.py\n"}
    for path, text in files.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    (base / "bin.dat").write_bytes(b"\0\1" * 20)
    (base / "link").symlink_to(base / "a")
    return str(base)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 4, 1000])
def test_tree_equals_scan(spark, root, partitions):
    assert rows(tree.tree_files(spark, root, partitions=partitions)) == rows(scan.project_files(spark, root))


def test_tree_settings(spark, root, tmp_path):
    for settings in ({"sensitive": False, "use_gitignore": False}, {"max_bytes": 40}, {"extra": ("flat", "*.md")}):
        assert rows(tree.tree_files(spark, root, **settings)) == rows(scan.project_files(spark, root, **settings))
    (tmp_path / "none").mkdir()
    assert tree.tree_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="NotADirectory"):
        tree.tree_files(spark, f"{root}/top.md")


def test_conditions_reach_the_source(spark, root):
    tree.register(spark)
    every = spark.read.format("source_tree").load(root)
    raw = every.where("size_bytes > 30 and size_bytes <= 200 and path like 'a/b1%' and path not like '%7.py'")
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.split("\n") if "Filter" in x and "BatchScan" not in x] == [x for x in plan.split("\n") if "Filter NOT EndsWith(path" in x]  # all else is the source's
    want = [(p, n) for p, n, _ in rows(every) if 30 < n <= 200 and p.startswith("a/b1") and not p.endswith("7.py")]
    assert [(p, n) for p, n, _ in rows(raw)] == want and want
    small = F.col("size_bytes") < 20
    assert {r.path for r in tree.tree_files(spark, root, only=small).collect()} == {r.path for r in scan.project_files(spark, root).where(small).collect()}


def test_excluded_files_are_not_opened(root, monkeypatch):
    opened, walked = [], []
    real, listed = open, scan.listed

    def counted(path, *a, **b):
        if not str(path).endswith((".gitignore", "exclude")):
            opened.append(os.path.relpath(path, root))
        return real(path, *a, **b)

    monkeypatch.setattr("builtins.open", counted)
    monkeypatch.setattr(scan, "listed", lambda r, folder, *a: walked.append(folder) or listed(r, folder, *a))
    reader = tree.TreeReader({"path": root, "partitions": "3"})
    other = In(("path",), ("a",))
    assert list(reader.pushFilters([GreaterThan(("size_bytes",), 100), LessThanOrEqual(("size_bytes",), 300), StringStartsWith(("path",), "a/b2"), other])) == [other]
    got = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column("path").to_pylist()]
    assert sorted(got) == sorted(opened) and got and all(100 < os.path.getsize(f"{root}/{p}") <= 300 and p.startswith("a/b2") for p in got)
    assert "flat" not in walked and "a/b1" not in walked
    opened.clear()
    reader = tree.TreeReader({"path": root})
    assert len(list(reader.pushFilters([EqualTo(("size_bytes",), -1)]))) == 0
    assert not [b for part in reader.partitions() for b in reader.read(part)] and not opened


def lines(spark, n=1000, parts=5):
    return spark.range(n).select(F.concat(F.lit("data/s"), (F.col("id") % 2).cast("string")).alias("folder"), F.to_json(F.struct("id")).alias("line")).repartitionByRange(parts, "folder", "line").sortWithinPartitions("folder", "line")


def held(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(path) for f in fs}


def test_lines_and_manifest(spark, tmp_path):
    out = str(tmp_path / "out")
    told = commit.save(lines(spark), out, {"project": "p"}, {"card": "# Card\n"})
    files = held(out)
    assert told["project"] == "p" and told["total_rows"] == 1000 and files.pop("card") == b"# Card\n" and json.loads(files.pop("manifest.json")) == told
    assert {f["name"] for f in told["files"]} == set(files) and all(f["bytes"] == len(files[f["name"]]) and f["sha256"] == hashlib.sha256(files[f["name"]]).hexdigest() and f["rows"] == files[f["name"]].count(b"\n") for f in told["files"])
    assert sorted(int(json.loads(x)["id"]) for data in files.values() for x in data.splitlines()) == list(range(1000))
    assert commit.verified(out) == [] and os.listdir(tmp_path) == ["out"]
    before = held(out)
    assert commit.save(lines(spark), out, {"project": "p"}, {"card": "# Card\n"}) == told and held(out) == before  # the same bytes again
    with pytest.raises(Exception, match="FileExists"):
        commit.save(lines(spark), out, overwrite=False)
    name = told["files"][0]["name"]
    with open(f"{out}/{name}", "ab") as f:
        f.write(b"{}\n")
    assert commit.verified(out) == [name]
    assert commit.save(lines(spark).limit(0), str(tmp_path / "none"))["files"] == []


@pytest.mark.parametrize("bad", ["no json", "fails"])
def test_all_or_nothing(spark, tmp_path, bad):
    out = str(tmp_path / "out")
    commit.save(lines(spark, 10), out)
    before = held(out)
    wrong = F.when(F.get_json_object("line", "$.id") == "7", F.lit("{")).otherwise(F.col("line")) if bad == "no json" else F.when(F.get_json_object("line", "$.id") == "7", F.raise_error(F.lit("lost"))).otherwise(F.col("line"))
    with pytest.raises(Exception, match="Expecting property name|lost"):
        commit.save(lines(spark).withColumn("line", wrong), out)
    assert held(out) == before
    with pytest.raises(Exception, match="Expecting property name|lost"):
        commit.save(lines(spark).withColumn("line", wrong), str(tmp_path / "new"))
    # tasks that were still at work when the job was given up may leave parts, no results
    assert not (tmp_path / "new").exists() and [str(p) for p in tmp_path.rglob("manifest.json")] == [f"{out}/manifest.json"] and not list(tmp_path.rglob("new*/**/part-*"))


def test_attempts_that_do_not_count(tmp_path):
    """What a lost attempt left in the folder is no part of the result."""
    writer = commit.LinesWriter({"path": str(tmp_path / "out")}, ["line"], True)
    os.makedirs(writer.stage)
    for name in ("_part-00000-1-x", "_part-00000-2-y"):
        with open(f"{writer.stage}/{name}", "w") as f:
            f.write("{}\n")
    writer.commit([commit.Written([commit.Part(f"{writer.stage}/_part-00000-2-y", "part-00000.jsonl", 1, 3, "s")]), None])
    assert sorted(os.listdir(tmp_path / "out")) == ["manifest.json", "part-00000.jsonl"]


def test_export_depends_on_samples_alone(spark, tmp_path):
    from corpuslathe import queries

    samples = queries.samples(spark, "/root/testdata/sf0.001")
    from datetime import datetime

    now, styles = datetime(2026, 1, 1), ("OpenAI", "Alpaca")
    for i, given in enumerate((samples, samples.repartition(7), samples.coalesce(1))):
        told = export.export(given, str(tmp_path / f"o{i}"), styles, "p", now, lines_a_file=5)
    assert held(tmp_path / "o0") == held(tmp_path / "o1") == held(tmp_path / "o2")
    n = samples.count()
    assert told["total_samples"] == n and len(told["files"]) == 2 * -(-n // 5) and told["formats"] == list(styles)
    order = [r.line for r in export.formatted(samples, "OpenAI").orderBy("ord").collect()]
    assert [x for f in told["files"] if "openai" in f["name"] for x in (tmp_path / "o0" / f["name"]).read_text().splitlines()] == order
    assert "manifest.json" not in held(tmp_path / "o3") if export.export(samples, str(tmp_path / "o3"), styles, "p", now, manifest=False) is None else False


def test_payload_of_a_staged_folder(spark, tmp_path):
    """A plain loop over the files gives the same objects, uploads and lines."""
    import base64

    files = {"data/a/part-1.jsonl": b"{}\n" * 50, "data/a/part-2.jsonl": b"x" * 500, "data/b/part-1.jsonl": b"x" * 500, "card": "# é\n".encode(), "data/c d/p.bin": bytes(range(256))}
    for path, data in files.items():
        (tmp_path / "out" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "out" / path).write_bytes(data)
    found = staging.objects(spark, str(tmp_path / "out"), inline_bytes=300)
    digest = lambda d: hashlib.sha256(d).hexdigest()
    from urllib.parse import unquote

    want = sorted((p, len(d), digest(d), len(d) > 300) for p, d in files.items())
    assert sorted((unquote(r.path), r.size_bytes, r.sha256, r.large) for r in found.collect()) == want
    assert [tuple(r) for r in staging.uploads(found).collect()] == [(digest(b"x" * 500), 500, "data/a/part-2.jsonl")]
    lines = [json.loads(r.line) for r in staging.payload(found, "Add", "About").orderBy("ord").collect()]
    assert lines[0] == {"key": "header", "value": {"summary": "Add", "description": "About"}}
    told = {unquote(x["value"]["path"]): x for x in lines[1:]}
    for p, d in files.items():
        inline = {"key": "file", "value": {"content": base64.b64encode(d).decode(), "encoding": "base64", "path": told[p]["value"]["path"]}}
        large = {"key": "lfsFile", "value": {"algo": "sha256", "oid": digest(d), "path": told[p]["value"]["path"], "size": len(d)}}
        assert told[p] == (large if len(d) > 300 else inline)
    (tmp_path / "none").mkdir()
    assert staging.payload(staging.objects(spark, str(tmp_path / "none")), "s").count() == 1


def test_language_by_content(spark):
    cases = [
        ("a.h", "#include <stdio.h>\ntypedef struct node { int x; } node;\nvoid f(struct node *n);\n", "C"), ("b.h", "#include <vector>\nnamespace q {\ntemplate <class T>\nclass Box {\npublic:\n  std::vector<T> x;\n};\n}\n", "C++"),
        ("c.h", "int f(void);\n", "C"), ("d.h", "", "C"), ("e.h", None, "C"), ("f.ts", '<?xml version="1.0"?>\n<!DOCTYPE TS>\n', "XML"), ("g.ts", "export const a = 1;\n", "TypeScript"),
        ("h.m", "#import <Foundation/Foundation.h>\n@implementation A\n@end\n", "Objective-C"), ("i.m", "function y = f(x)\n% doubles\ny = 2 * x;\n", "MATLAB"), ("j.pl", "use strict;\nmy $x = 1;\n", "Perl"), ("k.pl", ":- module(a, []).\nf(X) :- g(X).\n", "Prolog"),
        ("l.py", "class A:\n", "Python"), ("Makefile", "a:\n", "Makefile"), ("n", "#!/bin/sh\n", "Shell"),
    ]
    df = spark.createDataFrame(cases, "path string, content string, want string").select("*", detect.language(F.col("path"), F.col("content")).alias("got"))
    assert {r.path: r.got for r in df.collect()} == {p: w for p, _, w in cases}


def test_order_statistics_by_ranges(spark):
    import random

    r = random.Random(3)
    for values in ([], [7], [1, 2], [r.randrange(40) for _ in range(999)], [5] * 400 + [r.randrange(10**9) for _ in range(601)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(5)
        got, v, n = statistics.order_statistics(df, "v").first(), sorted(values), len(values)
        at = lambda i: v[int(i)] if v else 0
        assert tuple(got) == (n, sum(v), at(0), at(-1), sum(v) // n if v else 0, at(n // 2), at((n - 1) * 0.9), at((n - 1) * 0.99))
