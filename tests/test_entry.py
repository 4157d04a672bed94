"""Every registered query of the engine against its SQL, and the text functions."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from corpuslathe import queries
from corpuslathe.functions import text as T
from corpuslathe.functions.tokens import sample_text
from corpuslathe.operators import dedup, quality
from corpuslathe.plans.config import Config, Quality
from corpuslathe.sources import detect, scan
from corpuslathe.streaming import progress

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v)
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name in queries.SQL:
        assert rows(got) == rows(duck.execute(queries.SQL[name]).df())
    else:
        assert len(got.columns)


def test_yaml_of_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.escaped for r in queries.QUERIES["yaml_texts"](spark, sf).collect()}
    assert max(map(len, texts.values())) > 80
    assert got == {i: t.replace('"', '\\"').replace("\n", " ").replace("\r", "").replace(":", " -") for i, t in texts.items()}


def sentences(text, most=3, size=500):
    out, n = "", 0
    for c in text:
        if len(out.encode()) >= size:
            return (out[: out.rfind(" ")] if " " in out else out).strip() + "..." if (out[: out.rfind(" ")] if " " in out else out).strip() else "..."
        out += c
        n += c in ".!?"
        if c in ".!?" and n >= most:
            break
    return out.strip()


def test_truncation_at_whole_characters(spark):
    """Characters of one to four bytes around the limit, with and without blanks."""
    texts = [c * k + " " + c * 700 for c in "aé日𝒳" for k in (120, 124, 125, 166, 167, 249, 250, 498, 499, 500, 501)]
    texts += ["x" * (500 - i) + c + " more words" for c in "é日𝒳\ufffd" for i in range(5)] + ["One. Two! Three? Four.", "", "  ", "a" * 500, "a" * 501, "One. " + "é" * 400 + ". Three. Four"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.truncated_sentences(F.col("t")).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    assert {i: got[i] for i in got} == {i: sentences(t) for i, t in enumerate(texts)}


def test_dedup_of_the_survey(spark, sf):
    """The survey's own count at this size, and the text that is compared."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    assert docs.count() - dedup.deduplicated(docs.select(F.col("doc_id").alias("ord"), "text"), F.col("text")).count() == 115
    turns = F.array(*(F.struct(F.lit("user").alias("role"), F.lit(t).alias("content"), F.array(F.struct(F.lit("f").alias("function_name"))).alias("tool_calls")) for t in ("a", "b")))
    assert spark.range(1).select(sample_text(turns).alias("x")).first().x == "a\nb"


def test_repairs(spark):
    assert one(spark, T.code_block, "Fill\n```py\na\n```inner```\nb\n```") == "a\n```inner```\nb\n"
    assert one(spark, T.code_block, "```py\na\n``` and text") == "a\n" and one(spark, T.code_block, "none") is None
    kinds = spark.createDataFrame([(["demo.sln", "x"],), (["app.csproj"],), (["a.txt"],)], "n array<string>").select(detect.project_type(F.col("n")).alias("k")).collect()
    assert [r.k for r in kinds] == ["dotnet", "dotnet", None]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first().x


def rust_lines(text):
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \r\n`é", max_size=12), min_size=20, max_size=20))
def test_lines(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.line_count(F.col("t")).alias("n"), T.fenced_line_count(F.col("t")).alias("f"))
    for r in df.collect():
        assert r.n == len(rust_lines(r.t))
        after = [i for i, x in enumerate(rust_lines(r.t)) if x.startswith("```")]
        body = rust_lines(r.t)[after[0] + 1 :] if after else []
        stop = next((i for i, x in enumerate(body) if x.startswith("```")), len(body))
        assert r.f == len(rust_lines("\n".join(body[:stop])) if "\n".join(body[:stop]) else [])


def test_text_functions(spark):
    cut = lambda n, b: lambda c: T.truncated_sentences(c, n, b)
    assert one(spark, cut(2, 500), "First one. Second one. Third one. Fourth.") == "First one. Second one."
    assert len(one(spark, cut(10, 30), "This is one very long sentence that goes on and on without an end")) <= 33
    assert one(spark, cut(3, 500), "no end") == "no end"
    for name, said in {"get_user_name": "retrieves user name", "isReady": "isreadys ", "create_x": "creates a new x", "__": "performs an operation", "sort_it": "sorts it"}.items():
        assert one(spark, T.purpose_of_name, name) == said
    assert one(spark, T.parent_dir, "a/b/c.rs") == "a/b" and one(spark, T.parent_dir, "c.rs") == ""
    assert one(spark, T.stem, "a/b.c.rs") == "b.c" and one(spark, T.stem, "a/.env") == ".env"
    assert one(spark, lambda c: T.last_lines(c, 2), "a\nb\nc\n") == "b\nc" and one(spark, lambda c: T.first_lines(c, 2), "a\nb\nc") == "a\nb" and one(spark, lambda c: T.first_lines(c, 9), "a\n") == "a\n"
    assert one(spark, T.code_block, "x\n```py\na\n```\ny") == "a\n" and one(spark, T.code_block, "x ``` y") is None
    assert one(spark, T.estimated_tokens, "three short words") == (17 * 10 // 35 + 3 * 13 // 10) // 2
    assert one(spark, T.safe_name, "Ab c/é-1") == "ab_c_é-1"
    assert one(spark, lambda p, c: quality.is_generated(p, c), "src/x.rs", "// @generated by y") and not one(spark, lambda p, c: quality.is_generated(p, c), "src/x.rs", "plain")
    assert one(spark, lambda p, c: quality.is_generated(p, c), "a/Cargo.lock", "") and one(spark, lambda c: quality.is_boilerplate(c), "fn get()")
    assert one(spark, detect.language, "a/b.tsx") == "TypeScript" and one(spark, detect.language, "a/run", "#!/usr/bin/env python3\nx") == "Python" and one(spark, detect.mapped_name, "SCSS") == "CSS"


README = """# Name

[![build](https://img.shields.io/a.svg)](b) [![c](https://img.shields.io/d.svg)](e)

The tool does *one* thing, with [links](x) and `code`. It is small.

```sh
skip. this!
```

## More

- item one
- item two
"""


def test_description(spark):
    got = scan.description(spark.createDataFrame([(README,), ("",), (None,)], "content string")).collect()
    assert got[0].description.startswith("The tool does one thing, with links and `code`. It is small.") and "shields" not in got[0].description and "skip" not in got[0].description
    assert got[1].description == "" and got[2].description is None


def test_config():
    assert Config().formats == ("OpenAI", "ChatML")
    for wrong in (lambda: Quality(min_tokens=9, max_tokens=8), lambda: Config(token_budget=0), lambda: Config(enabled_types=("x",))):
        with pytest.raises(ValueError):
            wrong()


def test_stream(spark, sf, tmp_path):
    """The windowed counts as a stream give what the batch gives."""
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = progress.windowed_counts(stream, "ts", "event_type")
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = progress.windowed_counts(batch, "ts", "event_type").select("start", "event_type", "n").toPandas()
    assert rows(spark.table("counts").select("start", "event_type", "n").toPandas()) == rows(want)


def test_progress(spark):
    log = [(1, 1, "started", "scan", 0, 0), (1, 2, "progress", "scan", 1, 4), (1, 3, "progress", "scan", 3, 4), (1, 4, "completed", "scan", 0, 0), (1, 5, "started", "export", 0, 0)]
    got = {r.phase: r for r in progress.completed_phases(spark.createDataFrame(log, "run int, seq int, event string, phase string, current int, total int")).collect()}
    assert got["scan"].completed and got["scan"].percent == 75 and got["export"].started and not got["export"].completed and got["export"].percent == 0
